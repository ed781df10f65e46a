"""Third-party packages: what code imports, and what manifests declare."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions import paths

#: Packages by the (lower-case) name under which they are imported; top names that only three parts of identify; modules of the runtime; tools that are run, not imported.
ALIASES = {
    "yaml": "pyyaml", "pil": "pillow", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "cv2": "opencv-python", "dateutil": "python-dateutil", "jwt": "pyjwt", "dotenv": "python-dotenv",
    "attr": "attrs", "openssl": "pyopenssl", "crypto": "pycryptodome", "magic": "python-magic", "serial": "pyserial", "git": "gitpython", "docx": "python-docx", "pptx": "python-pptx",
    "zmq": "pyzmq", "skimage": "scikit-image", "google.protobuf": "protobuf", "multipart": "python-multipart", "jose": "python-jose", "slugify": "python-slugify", "psycopg2": "psycopg2-binary",
}
NAMESPACES = ("google", "azure")
NODE_BUILTINS = tuple("assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split())
TOOLS = tuple("pytest* black ruff flake8* mypy isort pre-commit coverage tox nox pylint sphinx* twine build wheel setuptools* pip hatch* poetry* flit* uvicorn gunicorn ipykernel jupyter* eslint* @eslint/* prettier* typescript @types/* types-* jest* vitest webpack* vite @vitejs/* babel* @babel/* ts-node tsx nodemon husky lint-staged rollup* @rollup/* esbuild concurrently rimraf @typescript-eslint/* stylelint* postcss* autoprefixer tailwindcss playwright @playwright/* cypress".split())


def local_names(files: DataFrame) -> DataFrame:
    """name: every folder segment and every module name of the repository, normalised."""
    stem = F.regexp_replace(paths.name_of(F.col("rel")), r"(.)\.[^.]*$", "$1")
    return files.select(F.explode(F.concat(paths.dirs_of(F.col("rel")), F.array(stem))).alias("raw")).select(paths.package_name(F.col("raw")).alias("name")).where("name <> ''").distinct()


def python_packages(imports: DataFrame, local: DataFrame) -> DataFrame:
    """rel, spec -> rel, package: by alias or top name, unless it is relative, of the standard library or of the repository."""
    import sys

    parts = F.split("spec", r"\.")
    some = imports.where(~F.col("spec").startswith(".") & (F.col("spec") != "")).select("rel", parts.alias("p"), F.element_at(parts, 1).alias("top"))
    some = some.where(~F.col("top").isin("__future__", *sorted(sys.stdlib_module_names))).withColumn("name", paths.package_name(F.col("top")))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    lead = lambda n: F.array_join(F.slice("p", 1, n), ".")
    known = F.coalesce(F.try_element_at(alias, F.lower(lead(2))), F.try_element_at(alias, F.lower("top")), F.col("top"))
    package = F.when(F.col("top").isin(*NAMESPACES) & (F.size("p") >= 3), lead(3)).otherwise(known)
    return some.join(local, "name", "left_anti").select("rel", paths.package_name(package).alias("package")).distinct()


def npm_packages(imports: DataFrame, local: DataFrame) -> DataFrame:
    """rel, spec -> rel, package (scope and name, whatever path follows), without built-ins, aliases of paths and the repository's own names."""
    whole = F.regexp_extract("spec", "^(?:@[^/]+/)?[^/]+", 0)
    some = imports.where(~F.col("spec").rlike("^(node:|@/|~|#|[./]|$)")).select("rel", whole.alias("whole"), paths.package_name(whole).alias("name"))
    return some.where(~F.col("whole").isin(*NODE_BUILTINS)).join(local, "name", "left_anti").select("rel", F.col("name").alias("package")).distinct()


def usage(used: DataFrame, declared: DataFrame, files: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """package, files, folders, declared: the most used packages."""
    told = declared.select("package", F.lit(True).alias("declared")).distinct()
    counts = used.join(files.select("rel", "district"), "rel").groupBy("package").agg(F.countDistinct("rel").alias("files"), F.countDistinct("district").alias("folders"))
    return counts.join(told, "package", "left").na.fill(False, ["declared"]).orderBy(F.desc("files"), "package").limit(th.packages)


def mismatches(used: DataFrame, declared: DataFrame) -> DataFrame:
    """package, kind of one ecosystem: imported but not declared (where anything is), or declared but not imported; tools are expected to be unused."""
    u, d = used.select("package").distinct(), declared.select("package").distinct()
    some = d.agg((F.count("*") > 0).alias("some"))
    missing = u.join(d, "package", "left_anti").crossJoin(F.broadcast(some)).where("some").select("package", F.lit("undeclared").alias("kind"))
    run = "|".join(paths.glob_regex(p) if "*" in p else f"^{p}$" for p in TOOLS)
    idle = d.where(~F.col("package").rlike(run)).join(u, "package", "left_anti").withColumn("kind", F.lit("unused"))
    return missing.unionByName(idle)


#: Where a pyproject.toml and a package.json list packages; a star stands for every key.
LISTS = ("project.dependencies", "project.optional-dependencies.*", "dependency-groups.*")
TABLES = ("tool.poetry.dependencies", "tool.poetry.dev-dependencies", "tool.poetry.group.*.dependencies")
NPM_TABLES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: The name at the start of a requirement; lines of a requirements file that are options or addresses.
REQUIREMENT, NO_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)"), re.compile(r"\s*(?:-|git\+|https?:)")


def _under(data, places: tuple[str, ...], kind: type) -> list:
    """The values of one kind at the places of a nested table; what has another shape is passed over."""
    out = []
    for place in places:
        at = [data]
        for step in place.split("."):
            tables = [x for x in at if isinstance(x, dict)]
            at = [v for x in tables for v in (x.values() if step == "*" else [x.get(step)])]
        out += [x for x in at if isinstance(x, kind)]
    return out


def parse_manifest(name: str, text: str) -> list[tuple[str, str]]:
    """(ecosystem, package), sorted and once each, of a requirements file, pyproject.toml or package.json; what cannot be read declares nothing."""
    base = name.rsplit("/", 1)[-1].lower()
    norm = lambda x: re.sub(r"[-_.]+", "-", x.strip()).lower()
    first = lambda lines: {norm(m[1]) for x in lines if isinstance(x, str) and (m := REQUIREMENT.match(x))}
    if base.startswith("requirements") and base.endswith((".txt", ".in")):
        return [("python", x) for x in sorted(first(x.split("#", 1)[0] for x in text.splitlines() if not NO_REQUIREMENT.match(x)))]
    if base == "pyproject.toml":
        import tomllib

        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        keys = {norm(k) for table in _under(data, TABLES, dict) for k in table} - {"python"}
        return [("python", x) for x in sorted(first(x for specs in _under(data, LISTS, list) for x in specs) | keys)]
    if base == "package.json":
        try:
            data = json.loads(text)
        except ValueError:
            return []
        return [("npm", x) for x in sorted({norm(k) for table in _under(data, NPM_TABLES, dict) for k in table})]
    return []
