"""PII: format-preserving Feistel pseudonyms.

Values of one fixed form are marked in the text by one regular expression pass, validated, and
replaced in place; then, in what is left, runs of groups are marked, and the spans of groups
that are valid ibans, phones and cards replaced: of spans that overlap those that cover the most
digits. So numbers side by side are told apart by validation, however their digits are
grouped. The rest of the text is untouched. A pseudonym depends on the key,
the kind and the value alone, so equal values stay linked across documents, and its
format is that of the value: separators, digit counts and check digits stay valid.

* card: 13-19 digits that pass Luhn, in one group or in any, with a space or hyphen between them (one in ten of
  all digit strings passes). The first digit (the issuer class) stays, the digits
  between it and the check digit are permuted, the check digit is made anew.
* ssn: ddd-dd-dddd with a valid area, group and serial, permuted within the valid ones.
* iban: passes modulo 97; the digits after the check digits are permuted, the check digits made anew.
* phone: 8 to 15 digits, after a plus in any groups, in brackets or not; without it as
  (dd) ddd dddd with two to four, three or four, and three or four digits, or as ddd-ddd-dddd; the country code, a zero that leads behind it (or the whole) and the first digit after these stay, the others
  are permuted. So +44 20 7946 0958, +442079460958, +44 (0)20 7946 0958 and (020) 7946 0958 have the same new digits.
* ip: four numbers up to 255, permuted as a 32-bit number.
* date: a calendar date of 1900-2099 (y-m-d, d/m/y or m/d/y, d.m.y), permuted within those years.
* email: not a number; letters and digits before the @ are drawn anew from a keyed digest,
  and so is the first label of the domain; other characters and the rest of the domain stay.

A candidate that fails validation stays as it is, and is not counted.

Defined results: null text stays null with zero counts; every row and column is kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CLOSE, ESCAPE, MARK, OPEN, has_marks, plain
from .feistel import permute, permute_below, secret_round

#: Java patterns of the kinds of one fixed form, tried in this order at each place. Repeats of groups are possessive, as
#: Java takes one frame of the stack for each repeat of another kind. A phone with dots all
#: through is among them, as its parts may look like an address; its digits are counted by the pattern.
FIXED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+])\+(?=(?:\.?[0-9]){8,15}(?![0-9A-Za-z]|\.[0-9]))[0-9]{1,3}(?:\.[0-9]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
#: Runs of groups, in which a number may be any groups side by side; and a group with what separates it from the one before.
IBAN_RUN, IBAN_GROUP = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+", " ?[A-Z0-9]+"
_GROUP = r"(?:\+?[0-9]++|\([0-9]{1,4}\))(?![A-Za-z])"
NUMBER_RUN, NUMBER_GROUP = rf"(?<![0-9A-Za-z])(?=(?:[ .()+-]{{0,3}}[0-9]){{8}}){_GROUP}(?:[ .-]?{_GROUP})*+", r"[ .-]?(?:\+?[0-9]+|\([0-9]{1,4}\))"
#: Forms of whole numbers, and the usual ways to group a card.
IBAN = r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}$"
PLUS_PHONE = r"^\+[0-9]+(?:[ .-]?(?:[0-9]+|\([0-9]{1,4}\)))*$"
LOCAL_PHONE = r"^(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})$"
CARD = r"^\+?[0-9]+(?:[ -][0-9]+)*$"
#: Country calling codes of one and of two digits; all others have three.
ONE_DIGIT_CODES, TWO_DIGIT_CODES = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
USUAL_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: One of these must be in a text that has a candidate; quick to look for.
QUICK = r"[0-9@]"
FIRST_DAY, DAYS = "1900-01-01", 73049

LONG0 = lambda: F.lit(0).cast("long")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.split(c, "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit being the check digit."""
    step = lambda acc, ch: _let(ch.cast("int"), lambda d: F.struct((~acc["twice"]).alias("twice"), (acc["sum"] + F.when(acc["twice"], d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)).alias("sum")))
    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(False).alias("twice"), F.lit(0).alias("sum")), step)["sum"]


def mod97(text: Column) -> Column:
    """The number that text spells (letters count 10 to 35) modulo 97."""
    return F.aggregate(_chars(text), LONG0(), lambda acc, ch: F.when(ch.rlike("[0-9]"), (acc * 10 + ch.cast("long")) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97))


def permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of the same length (up to 36): halves as left and right of a Feistel network."""
    n = F.length(d)
    left = F.floor(n / 2).cast("int")
    a, b = F.rpad(F.lit("1"), left + 1, "0").cast("long"), F.rpad(F.lit("1"), n - left + 1, "0").cast("long")
    image = permute(F.when(left > 0, F.substring(d, F.lit(1), left)).otherwise("0").cast("long"), F.substring(d, left + 1, n - left).cast("long"), a, b, secret_round(key, F.concat(F.lit(kind), n.cast("string"))), 10)
    joined = _let(image, lambda p: F.concat(F.when(left > 0, F.lpad(p["l"].cast("string"), left, "0")).otherwise(""), F.lpad(p["r"].cast("string"), n - left, "0")))
    return F.when(n > 0, joined).otherwise(d)


def filled(value: Column, digits: Column) -> Column:
    """value with its digits replaced by those of digits, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, ch: F.when(ch.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], ch).alias("out"), acc["at"].alias("at")))
    return F.aggregate(_chars(value), start, step)["out"]


def card(v: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), n - 2), key, "card"))
        whole = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _let(whole, lambda w: filled(v, w)))

    return _let(_digits(v), new)


def ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    image = permute(index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), secret_round(key, F.lit("ssn")))

    def said(p: Column) -> Column:
        at = F.floor(p["l"] / 99)
        return F.concat_ws("-", F.lpad(F.when(at >= 665, at + 2).otherwise(at + 1).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(image, said))


def iban(v: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        rest = F.substring(s, F.lit(5), F.length(s) - 4)
        inner = _let(permuted_digits(_digits(rest), key, "iban"), lambda d: filled(rest, d))

        def whole(r: Column) -> Column:
            check = 98 - mod97(F.concat(r, F.substring(s, 1, 2), F.lit("00")))
            return F.concat(F.lpad(check.cast("string"), 2, "0"), _digits(r))

        return F.when(mod97(F.concat(rest, F.substring(s, 1, 4))) == 1, _let(_let(inner, whole), lambda d: filled(v, d)))

    return _let(F.replace(v, F.lit(" "), F.lit("")), new)


def phone(v: Column, key: str) -> Column:
    """Behind the country code, and a zero that leads there, the first digit stays: one number gets one pseudonym in whatever groups."""

    def new(d: Column) -> Column:
        code = F.when(v.startswith("+"), F.when(d.rlike(ONE_DIGIT_CODES), 1).when(d.rlike(TWO_DIGIT_CODES), 2).otherwise(3)).otherwise(0)

        def whole(code: Column) -> Column:
            fixed = code + F.when(F.substring(d, code + 1, F.lit(1)) == "0", 2).otherwise(1)
            return _let(fixed, lambda k: F.concat(F.substring(d, F.lit(1), k), permuted_digits(F.substring(d, k + 1, F.length(d)), key, "phone")))

        return F.when(F.length(d).between(8, 15), _let(_let(code, whole), lambda w: filled(v, w)))

    return _let(_digits(v), new)


def ip(v: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        part = lambda i: F.element_at(p, i).cast("long")
        image = permute(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536).cast("long"), F.lit(65536).cast("long"), secret_round(key, F.lit("ip")))
        said = _let(image, lambda q: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(q[h] / 256), q[h] % 256)]))
        return F.when((part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256), said)

    return _let(F.split(v, r"\."), new)


def date(v: Column, key: str) -> Column:
    first = F.regexp_extract(v, "^([0-9]+)", 1)
    second = F.regexp_extract(v, "^[0-9]+[/.-]([0-9]+)", 1)
    third = F.regexp_extract(v, "([0-9]+)$", 1)
    iso = F.contains(v, F.lit("-"))
    # d/m/y where that is a date, else m/d/y; each reading is written back as it was read.
    dmy = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.try_to_date(F.concat_ws("-", third, F.lpad(second, 2, "0"), F.lpad(first, 2, "0")), "yyyy-MM-dd"))
    mdy = F.when(F.contains(v, F.lit("/")), F.try_to_date(F.concat_ws("-", third, F.lpad(first, 2, "0"), F.lpad(second, 2, "0")), "yyyy-MM-dd"))

    def new(day: Column) -> Column:
        image = permute_below(F.datediff(day, F.lit(FIRST_DAY).cast("date")), DAYS, secret_round(key, F.lit("date")))

        def said(at: Column) -> Column:
            d = F.date_add(F.lit(FIRST_DAY).cast("date"), at.cast("int"))
            y, m, dd = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
            sep = F.when(F.contains(v, F.lit("/")), "/").otherwise(".")
            return F.when(iso, F.concat_ws("-", y, m, dd)).when(dmy.isNotNull(), F.concat(dd, sep, m, sep, y)).otherwise(F.concat(m, sep, dd, sep, y))

        return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), _let(image, said))

    return _let(F.coalesce(dmy, mdy), new)


def email(v: Column, key: str) -> Column:
    """Characters are drawn one by one from a keyed digest of the whole address; its length and its character classes stay."""
    at = F.instr(v, "@")
    label = F.regexp_extract(v, "@([^.]+)", 1)
    head = at + F.length(label)

    def drawn(seed: Column) -> Column:
        letters, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")
        step = lambda acc, ch: _let(
            F.conv(F.substring(F.sha2(F.concat(seed, F.length(acc).cast("string")), 256), 1, 8), 16, 10).cast("long"),
            lambda x: F.concat(acc, F.when(ch.rlike("[a-zA-Z]"), F.substring(letters, (x % 26 + 1).cast("int"), F.lit(1))).when(ch.rlike("[0-9]"), F.substring(digits, (x % 10 + 1).cast("int"), F.lit(1))).otherwise(ch)),
        )
        return F.aggregate(_chars(F.substring(v, F.lit(1), head)), F.lit(""), step)

    return F.concat(_let(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(v)), 256), drawn), F.substring(v, head + 1, F.length(v)))


MAKERS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
#: Around what a pass is to look at.
CUT = MARK + "\u0005"
CHUNK = 256
BEST, SPANS = "array<struct<score:int,n:int,kind:string>>", "array<struct<at:int,n:int,kind:string>>"


def _opening(kind: str) -> str:
    return OPEN + chr(ord("a") + KINDS.index(kind))


def _fenced(kind: str, value: Column) -> Column:
    return F.concat(F.lit(_opening(kind)), value, F.lit(CLOSE))


def _judged(weight: Column, kind: str) -> Column:
    return F.struct(weight.cast("int").alias("weight"), F.lit(kind).alias("kind"))


def fixed(v: Column, key: str) -> Column:
    """v fenced, by the first kind that has its form; v itself if it is not valid."""
    return F.coalesce(F.coalesce(*[F.when(v.rlike(f"^(?:{p})$"), F.struct(_fenced(k, MAKERS[k](v, key)).alias("v"))) for k, p in FIXED.items()])["v"], v)


def judged_iban(v: Column, after: Column) -> Column:
    bare = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare) - 4), F.substring(bare, 1, 4))
    return F.when(v.rlike(IBAN), F.when(mod97(turned) == 1, _judged(F.length(bare), "iban")))


def judged_number(v: Column, after: Column) -> Column:
    """Weighs as many digits as it has; more a phone with +1 of eleven digits, as all of these are; less a card in unusual groups."""

    def new(d: Column) -> Column:
        n = F.length(d)
        plus = v.rlike(PLUS_PHONE) & ~after.startswith(".")
        phone_ = F.when(n.between(8, 15) & (plus | v.rlike(LOCAL_PHONE)), _judged(F.when(v.startswith("+1") & (n == 11), 16).otherwise(n), "phone"))
        card_ = F.when(n.between(13, 19) & v.rlike(CARD), F.when(luhn_sum(d) % 10 == 0, _judged(F.when(v.rlike(USUAL_CARD), n).otherwise(n - 6), "card")))
        return F.coalesce(phone_, card_)

    return _let(_digits(v), new)


def split_at(text: Column, pattern: str) -> Column:
    """text cut at the matches of pattern outside of fences; they, and fences, are the entries at odd places (from 0)."""
    return F.split(F.regexp_replace(text, F.lit(f"{OPEN}[^{MARK}]*+{CLOSE}|{pattern}"), F.lit(f"{CUT}$0{CUT}")), CUT)


def is_match(x: Column, i: Column) -> Column:
    return (i % 2 == 1) & ~x.startswith(OPEN)


def spans_of(groups: Column, longest: int, judge) -> Column:
    """By group: the spans of up to longest groups that begin with it and are a number as a whole, as struct<n,j>."""

    def begun(x: Column, i: Column) -> Column:
        def span(w: Column, n: Column) -> Column:
            after = F.coalesce(F.get(w, n), F.lit(""))
            body = F.regexp_replace(F.array_join(F.slice(w, F.lit(1), n), ""), "^[ .-]", "")
            judged = _let(body, lambda v: F.struct(n.alias("n"), judge(v, after).alias("j")))
            return F.when((after == "") | after.rlike("^[ .-]"), judged)

        # One group more than the longest span, so that each has the one after it.
        spans = _let(F.slice(groups, i + 1, F.lit(longest + 1)), lambda w: F.transform(F.sequence(F.lit(1), F.least(F.size(w), F.lit(longest))), lambda n: span(w, n)))
        return F.when((i == 0) | x.rlike("^[ .-]"), F.filter(spans, lambda s: s["j"].isNotNull()))

    return F.transform(groups, begun)


def _chunked(array: Column, start: Column, step, value, kind: str) -> Column:
    """value(state) for each state that step makes from array, in order, nulls left out.

    An aggregate copies its whole state at each step, so the states of ``CHUNK`` entries are
    gathered by themselves, and those of all chunks beside the state that goes on.
    """
    empty, nested = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        grown = lambda state: F.struct(state.alias("state"), F.concat(acc["out"], F.filter(F.array(value(state)), lambda v: v.isNotNull())).alias("out"))
        return _let(step(acc["state"], x), grown)

    def whole(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["done"], F.array(d["out"])).alias("done")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda i: F.slice(array, i * CHUNK + 1, F.lit(CHUNK)))
    found = F.aggregate(chunks, F.struct(start.alias("state"), nested.alias("done")), whole)["done"]
    return F.when(F.size(array) > 0, F.flatten(found)).otherwise(empty)


def best(spans: Column, longest: int) -> Column:
    """From each group on, the first first: the greatest weight of spans that do not overlap, and the span that begins there, if it is among them.

    The state holds what was found for the last longest groups, as no span is longer.
    """

    def step(acc: Column, begun: Column) -> Column:
        score = lambda n: F.get(acc, n - 1)["score"]
        none = F.array(F.struct(score(F.lit(1)).alias("score"), F.lit(0).alias("n"), F.lit("").alias("kind")))
        taken = F.transform(begun, lambda s: F.struct((s["j"]["weight"] + score(s["n"])).alias("score"), s["n"].alias("n"), s["j"]["kind"].alias("kind")))
        return F.slice(F.concat(F.array(F.array_max(F.concat(none, F.coalesce(taken, F.array().cast(BEST))))), acc), 1, longest)

    end = F.array(F.struct(F.lit(0).alias("score"), F.lit(0).alias("n"), F.lit("").alias("kind"))).cast(BEST)
    return F.reverse(_chunked(F.reverse(spans), end, step, lambda acc: F.get(acc, 0), BEST))


def chosen(best_: Column) -> Column:
    """The spans of the best choice, in the order of the text."""
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("next"), F.lit(None).cast(f"struct<{SPANS[13:-1]}").alias("span"))

    def step(acc: Column, b: Column) -> Column:
        i = acc["i"] + 1
        here = (i == acc["next"]) & (b["n"] > 0)
        after = F.when(here, i + b["n"]).otherwise(F.greatest(acc["next"], i + 1))
        return F.struct(i.alias("i"), after.alias("next"), F.when(here, F.struct(i.alias("at"), b["n"].alias("n"), b["kind"].alias("kind"))).alias("span"))

    return _chunked(best_, start, step, lambda acc: acc["span"], SPANS)


def written(groups: Column, spans: Column) -> Column:
    """The groups put together, with the new values in the place of spans."""
    end = lambda i: F.coalesce(F.get(spans, i)["at"] + F.get(spans, i)["n"], F.lit(1))
    between = lambda a, b: F.array_join(F.slice(groups, a, b - a), "")
    each = F.transform(spans, lambda s, i: F.concat(between(end(i - 1), s["at"]), s["v"]))
    return F.concat(F.array_join(each, ""), between(end(F.size(spans) - 1), F.size(groups) + 1))


def scanned(docs: DataFrame, run: str, group: str, longest: int, judge, kinds: tuple[str, ...], key: str) -> DataFrame:
    """docs with the numbers of these kinds fenced in _m. In steps, as the analyser takes lambdas in lambdas only so deep."""

    def lead(s: Column, v: Column) -> Column:
        return F.when(s["kind"] == "card", F.regexp_extract(v, r"^[ .-]?\+?", 0)).otherwise(F.regexp_extract(v, "^[ .-]?", 0))

    def texts(r: Column) -> Column:
        text = lambda s: F.array_join(F.slice(r["t"], s["at"], s["n"]), "")
        return F.transform(r["s"], lambda s: _let(text(s), lambda v: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["kind"].alias("kind"), lead(s, v).alias("lead"), v.alias("v"))))

    def value(s: Column) -> Column:
        body = F.substring(s["v"], F.length(s["lead"]) + 1, F.length(s["v"]))
        new = F.coalesce(*[F.when(s["kind"] == k, _fenced(k, MAKERS[k](body, key))) for k in kinds])
        return F.struct(s["at"].alias("at"), s["n"].alias("n"), F.concat(s["lead"], new).alias("v"))

    def each(spans) -> DataFrame:
        return docs.withColumn("_r", F.transform("_r", lambda r: F.struct(r["x"].alias("x"), r["t"].alias("t"), spans(r).alias("s"))))

    groups = lambda x, i: F.when(is_match(x, i), F.regexp_extract_all(x, F.lit(group), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("_r", F.transform(split_at(F.col("_m"), run), lambda x, i: F.struct(x.alias("x"), groups(x, i).alias("t"))))
    docs = each(lambda r: spans_of(r["t"], longest, judge))
    docs = each(lambda r: best(r["s"], longest))
    docs = each(lambda r: chosen(r["s"]))
    docs = each(texts)
    docs = each(lambda r: F.transform(r["s"], value))
    return docs.withColumn("_m", F.array_join(F.transform("_r", lambda r: F.when(F.size(r["s"]) > 0, written(r["t"], r["s"])).otherwise(r["x"])), "")).drop("_r")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and columns n_<kind> appended (they replace any of the same name). Who has the key can undo the numbers, so it has no default."""
    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    some = F.when(F.col("text").rlike(QUICK), F.replace(F.col("text"), F.lit(MARK), F.lit(ESCAPE)))
    done = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"), some.alias("_m"))
    done = done.withColumn("_m", F.array_join(F.transform(split_at(F.col("_m"), "|".join(FIXED.values())), lambda x, i: F.when(is_match(x, i), fixed(x, key)).otherwise(x)), ""))
    done = scanned(done, IBAN_RUN, IBAN_GROUP, 34, judged_iban, ("iban",), key)
    done = scanned(done, NUMBER_RUN, NUMBER_GROUP, 19, judged_number, ("phone", "card"), key)
    bare = F.regexp_replace("_m", f"{MARK}(?:\u0003[a-z]|\u0004)", "")
    text = F.when(has_marks(F.col("_m")), plain(bare)).otherwise(F.col("_text"))
    count = lambda k: F.coalesce(F.size(F.split("_m", _opening(k))) - 1, F.lit(0))
    return done.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names], *[F.when(has_marks(F.col("_m")), count(k)).otherwise(0).cast("long").alias(f"n_{k}") for k in KINDS])
