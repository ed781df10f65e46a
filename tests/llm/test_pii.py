"""Pseudonyms against a plain Python version, from the same patterns, on all documents; and links between spellings."""

import datetime
import hashlib
import math
import re

import pytest

from quarrylens.llm import pii
from quarrylens.llm.common import CLOSE, ESCAPE, MARK, OPEN

KEY = "another key"
ISO, FIRST = datetime.date.fromisoformat, datetime.date(1900, 1, 1)
DAYS = (datetime.date(2099, 12, 31) - FIRST).days + 1


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def swapped(l, r, a, b, tweak, rounds):
    for i in range(1, rounds + 1):
        f = lambda x, i=i: int(sha(f"{KEY}|{tweak}|{i}|{x}")[:14], 16)
        l, r = ((l + f(r)) % a, r) if i % 2 else (l, (r + f(l)) % b)
    return l, r


def digits_of(v):
    return re.sub("[^0-9]", "", v)


def permuted(d, kind):
    if not d:
        return d
    n, k = len(d), len(d) // 2
    l, r = swapped(int(d[:k] or 0), int(d[k:]), 10**k, 10 ** (n - k), f"{kind}{n}", 10)
    return (f"{l:0{k}d}" if k else "") + f"{r:0{n - k}d}"


def poured(v, d):
    left = iter(d)
    return re.sub("[0-9]", lambda _: next(left), v)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))


def card(v):
    d = digits_of(v)
    if luhn(d) % 10:
        return None
    body = d[0] + permuted(d[1:-1], "card")
    return poured(v, body + str(-luhn(body + "0") % 10))


def ssn(v):
    area, group, serial = map(int, v.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return None
    l, r = swapped(areas.index(area) * 99 + group - 1, serial - 1, len(areas) * 99, 9999, "ssn", 8)
    return f"{areas[l // 99]:03d}-{l % 99 + 1:02d}-{r + 1:04d}"


def of_letters(s):
    return int("".join(str(int(c, 36)) for c in s))


def iban(v):
    s = v.replace(" ", "")
    if of_letters(s[4:] + s[:4]) % 97 != 1:
        return None
    rest = poured(s[4:], permuted(digits_of(s[4:]), "iban"))
    return poured(v, f"{98 - of_letters(rest + s[:2] + '00') % 97:02d}" + digits_of(rest))


TWO = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}


def phone(v):
    d = digits_of(v)
    if not 8 <= len(d) <= 15:
        return None
    k = 0 if v[0] != "+" else 1 if d[0] in "17" else 2 if int(d[:2]) in TWO else 3
    k += 1 + (d[k] == "0")
    return poured(v, d[:k] + permuted(d[k:], "phone"))


def ip(v):
    p = list(map(int, v.split(".")))
    if max(p) > 255:
        return None
    l, r = swapped(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip", 8)
    return ".".join(map(str, (*divmod(l, 256), *divmod(r, 256))))


def day_of(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def date(v):
    sep = "-" if "-" in v else "/" if "/" in v else "."
    p = v.split(sep)
    first = day_of(*p) if sep == "-" else day_of(p[2], p[1], p[0])
    day = first or (day_of(p[2], p[0], p[1]) if sep == "/" else None)
    if not day or not 1900 <= day.year <= 2099:
        return None
    a = math.isqrt(DAYS - 1) + 1
    b = -(-DAYS // a)
    at = (day - FIRST).days
    while True:
        l, r = swapped(at // b, at % b, a, b, "date", 8)
        at = l * b + r
        if at < DAYS:
            break
    new = FIRST + datetime.timedelta(at)
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return sep.join((y, m, d) if sep == "-" else (d, m, y) if first else (m, d, y))


def email(v):
    name, domain = v.split("@")
    head = f"{name}@{domain.split('.')[0]}"
    seed, out = sha(f"{KEY}|email|{v.lower()}"), ""
    for c in head:
        x = int(sha(f"{seed}{len(out)}")[:8], 16)
        out += chr(97 + x % 26) if c.isalpha() else str(x % 10) if c.isdigit() else c
    return out + v[len(head) :]


MAKE = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def fence(kind, v):
    return f"{OPEN}{'abcdefg'[pii.KINDS.index(kind)]}{v}{CLOSE}"


def outside(text, pattern, do):
    return re.sub(f"{OPEN}[^{MARK}]*+{CLOSE}|{pattern}", lambda m: m[0] if m[0].startswith(OPEN) else do(m[0]), text)


def fixed(v):
    for kind, pattern in pii.FIXED.items():
        if re.search(f"^(?:{pattern})$", v) and (new := MAKE[kind](v)):
            return fence(kind, new)
    return v


def judged_iban(v, after):
    s = v.replace(" ", "")
    return (len(s), "iban") if re.search(pii.IBAN, v) and of_letters(s[4:] + s[:4]) % 97 == 1 else None


def judged_number(v, after):
    d = digits_of(v)
    if 8 <= len(d) <= 15 and (re.search(pii.PLUS_PHONE, v) and not after.startswith(".") or re.search(pii.LOCAL_PHONE, v)):
        return 16 if v.startswith("+1") and len(d) == 11 else len(d), "phone"
    if 13 <= len(d) <= 19 and re.search(pii.CARD, v) and luhn(d) % 10 == 0:
        return len(d) if re.search(pii.USUAL_CARD, v) else len(d) - 6, "card"
    return None


def scanned(run, group, longest, judge):
    """Of all choices of spans that do not overlap the heaviest, taken from the left."""
    g = [m[0] for m in re.finditer(group, run)]
    best = [None] * len(g) + [(0, 0, "")]
    for i in reversed(range(len(g))):
        best[i] = (best[i + 1][0], 0, "")
        for n in range(1, min(longest, len(g) - i) + 1):
            after = g[i + n] if i + n < len(g) else ""
            if (i == 0 or g[i][0] in " .-") and (not after or after[0] in " .-") and (j := judge(re.sub("^[ .-]", "", "".join(g[i : i + n])), after)):
                best[i] = max(best[i], (j[0] + best[i + n][0], n, j[1]))
    out, i = "", 0
    while i < len(g):
        _, n, kind = best[i]
        if n:
            v = "".join(g[i : i + n])
            lead = re.match(r"[ .-]?\+?" if kind == "card" else "[ .-]?", v)[0]
            out += lead + fence(kind, MAKE[kind](v[len(lead) :]))
        else:
            out += g[i]
        i += n or 1
    return out if any(b[1] for b in best) else run


def plain(text):
    """The text with pseudonyms, and how many there are of each kind."""
    if text is None or not re.search("[0-9@]", text):
        return text, dict.fromkeys(pii.KINDS, 0)
    m = outside(text.replace(MARK, ESCAPE), "|".join(pii.FIXED.values()), fixed)
    m = outside(m, pii.IBAN_RUN, lambda r: scanned(r, pii.IBAN_GROUP, 34, judged_iban))
    m = outside(m, pii.NUMBER_RUN, lambda r: scanned(r, pii.NUMBER_GROUP, 19, judged_number))
    counts = {k: m.count(fence(k, "")[: -len(CLOSE)]) for k in pii.KINDS}
    return re.sub(f"{OPEN}[a-g]|{CLOSE}", "", m).replace(ESCAPE, MARK), counts


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = dict.fromkeys(pii.KINDS, 0)
    for r in pii.pseudonymised(docs, KEY).collect():
        want, counts = plain(texts[r["doc_id"]])
        assert (r["text"], {k: r[f"n_{k}"] for k in pii.KINDS}) == (want, counts), r["doc_id"]
        for k, n in counts.items():
            found[k] += n
    assert sf == "0.001" or sum(n > 0 for n in found.values()) >= 3


def test_odd_values(spark):
    """Values of every kind, right and wrong, alone and side by side."""
    values = ["+1 555 123 4567", "+15551234567", "4111 1111 1111 1111", "123-45-6789", "665-01-0001", "667-99-9999", "899-01-0001", "900-01-0001", "GB82 WEST 1234 5698 7654 32", "0.0.0.0", "255.255.255.255", "1.2.3.256",
              "1900-01-01", "2099-12-31", "1899-12-31", "2024-02-30", "31/12/1999", "12/31/1999", "13/13/1999", "1.2.2003", "A.b-9@Sub9.example.co.uk", "x@y", "+385 1 234 5678", "+7 495 123 45 67", "(020) 7946 0958", "212-555-0199", "+39 06 698 12345", "a\u0001b 1"]
    texts = [*values, *(f"{a} {b}" for a in values for b in values[::3]), "; ".join(values), "", None, "no digits", "1 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pseudonymised(df, KEY).collect():
        want, counts = plain(texts[r["doc_id"]])
        assert (r["text"], {k: r[f"n_{k}"] for k in pii.KINDS}) == (want, counts), texts[r["doc_id"]]


@pytest.mark.parametrize("same", [["+1 555 123 4567", "+15551234567", "+1-555-123-4567", "+1 (555) 123-4567", "+1.555.123.4567", "+1 5551234567"], ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+44(0)2079460958", "+44 2079460958"], ["+358 9 1234567", "+35891234567", "+358 912 345 67"]])
def test_one_phone_has_one_pseudonym(spark, same):
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(same)), "doc_id long, text string"), KEY).collect()
    new = [digits_of(r["text"]) for r in rows]
    code = "44" if same[0].startswith("+44") else ""
    assert len({d if not code else re.sub(f"^{code}0?", "", d) for d in new}) == 1 and new[0] != digits_of(same[0])
    assert all(r["n_phone"] == 1 and re.sub("[0-9]", "0", r["text"]) == re.sub("[0-9]", "0", same[r["doc_id"]]) for r in rows)


def test_a_zero_for_calls_inland_is_not_of_the_number(spark):
    rows = pii.pseudonymised(spark.createDataFrame([(0, "(020) 7946 0958"), (1, "+44 20 7946 0958"), (2, "212-555-0199"), (3, "+12125550199")], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    d = [digits_of(r["text"]) for r in rows]
    assert d[0][1:] == d[1][2:] and d[0][0] == "0" and d[2] == d[3][1:]


def test_the_key_has_no_default(spark):
    with pytest.raises(TypeError):
        pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"))
