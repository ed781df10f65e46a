"""Columns over POSIX paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that classify files.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "testdata")
TEST_NAMES = (r"^test_.*\.py$", r"^.*_test\.(py|go|rb|js|ts)$", r"^.*\.(test|spec)\.(js|ts|jsx|tsx|mjs|cjs)$", r"^.*(Test|Tests|Spec)\.(java|kt|scala|cs)$", r"^conftest\.py$")
README_NAMES = ("readme.md", "readme.rst", "readme.txt", "readme", "readme.markdown")
CONFIG_NAMES = ("pyproject.toml", "setup.py", "setup.cfg", "package.json", "cargo.toml", "go.mod", "gemfile", "makefile", "dockerfile", ".gitignore", ".gitattributes", "requirements.txt", "tsconfig.json", "_config.yml")
VENDOR_DIRS = ("vendor", "vendors", "third_party", "thirdparty", "third-party", "external", "extern", "node_modules")
VENDOR_SUFFIXES = (".min.js", ".min.css", "-min.js", ".bundle.js")
NOISE_DIRS = (".git", ".hg", ".svn", "__pycache__", ".ipynb_checkpoints", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", "node_modules", ".venv", "venv", "env", ".bundle", "vendor", "dist", "build", ".next", ".nuxt", ".cache", ".idea", ".vscode", "_site", ".sass-cache", ".jekyll-cache")
NOISE_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", ".localized")
NOISE_SUFFIXES = (".log", ".tmp", ".bak", ".swp", ".swx", ".orig", ".rej", "~")
FIX_SUBJECT = (
    r"(?i)^(?:fix|hotfix|bugfix)(?:\([^)]*\))?!?:"
    r"|\b(?:fix(?:e[sd])?|fixing|bug|bugs|hotfix|bugfix|regression|revert(?:s|ed)?|patch(?:e[sd])?|crash(?:es)?)\b"
    r"|\b(?:close[sd]?|resolve[sd]?)\s+#\d+"
)
REVERT_SUBJECT = r"(?i)^\s*(?:revert\b|back(?:ed)?\s*out\b)"


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def name_of(rel: Column) -> Column:
    return F.element_at(parts(rel), -1)


def dirs_of(rel: Column) -> Column:
    p = parts(rel)
    return F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - 1))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_test(rel: Column) -> Column:
    """Whole directory segments, or the file name, say test; upper and lower case count."""
    name = name_of(rel)
    hit = F.arrays_overlap(dirs_of(rel), _words(TEST_DIRS))
    return hit | name.rlike("|".join(TEST_NAMES))


def is_doc(rel: Column) -> Column:
    return F.lower(name_of(rel)).isin(*README_NAMES)


def is_config(rel: Column) -> Column:
    return F.lower(name_of(rel)).isin(*CONFIG_NAMES)


def is_vendored(rel: Column) -> Column:
    low = F.lower(rel)
    hit = F.arrays_overlap(dirs_of(low), _words(VENDOR_DIRS))
    return hit | low.rlike("(" + "|".join(_quoted(s) for s in VENDOR_SUFFIXES) + ")$")


def is_noise(rel: Column) -> Column:
    return F.arrays_overlap(dirs_of(rel), _words(NOISE_DIRS)) | name_of(rel).isin(*NOISE_FILES) | rel.endswith(".pyc") | rel.endswith(".pyo")


def district(rel: Column, depth: int) -> Column:
    d = dirs_of(rel)
    return F.when(F.size(d) == 0, "(root)").otherwise(F.array_join(F.slice(d, 1, depth), "/"))


def folder(rel: Column) -> Column:
    return F.array_join(dirs_of(rel), "/")


def ancestors(rel: Column) -> Column:
    """Every folder above a file, from the top."""
    d = dirs_of(rel)
    return F.when(F.size(d) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(d)), lambda i: F.array_join(F.slice(d, F.lit(1), i), "/")))


def extension(rel: Column) -> Column:
    name = name_of(rel)
    ext = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def is_fix(subject: Column) -> Column:
    return subject.rlike(FIX_SUBJECT)


def is_revert(subject: Column) -> Column:
    return subject.rlike(REVERT_SUBJECT)


def package_name(name: Column) -> Column:
    """Names that differ in case or in runs of -, _ and . are one package."""
    return F.lower(F.regexp_replace(F.trim(name), "[-_.]+", "-"))


def test_stem(name: Column) -> Column:
    """The source stem that a test file's name points at, or empty."""
    p = F.split(name, r"\.")
    core = F.element_at(p, 1)
    middle = F.exists(F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 2)), lambda x: F.lower(x).isin("test", "tests", "spec"))
    hits = [F.regexp_extract(core, pattern, 1) for pattern in (r"(?i)^tests?_(.+)$", r"(?i)^(.+?)_(?:tests?|spec)$", r"^(.+?[a-z0-9])(?:Tests?|Spec)$")]
    found = F.coalesce(*[F.lower(F.nullif(h, F.lit(""))) for h in hits], F.lit(""))
    return F.when(core == "", "").when((F.size(p) > 2) & middle, F.lower(core)).otherwise(found)


def handle(text: Column) -> Column:
    """Letters and digits of a name, an address or a login."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def glob_regex(pattern: str) -> str:
    """A shell glob, or a plain prefix, as a regular expression over whole paths; ``x/**`` is also x itself."""
    pattern = pattern.strip().strip("/")
    if not pattern:
        return r"(?!)"
    if not any(c in pattern for c in "*?["):
        return f"^{_quoted(pattern)}(?:/.*)?$"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
            i = end
        else:
            out.append(_quoted(c))
        i += 1
    whole = "".join(out)
    return f"^(?:{whole}|{_quoted(pattern[:-3])}(?:/.*)?)$" if pattern.endswith("/**") else f"^(?:{whole})$"


def owners_regex(pattern: str) -> str:
    """A CODEOWNERS pattern as a regular expression over paths."""
    body = pattern.strip("/")
    steps = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, rest = "", body
    while rest:
        if rest == "/**":
            out, rest = out + "(?:/.*)?", ""
            continue
        token = next((t for t in steps if rest.startswith(t)), rest[0])
        out += steps.get(token) or _quoted(token)
        rest = rest[len(token) :]
    anchored = pattern.startswith("/") or "/" in body
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/-" else "\\" + c for c in text)
