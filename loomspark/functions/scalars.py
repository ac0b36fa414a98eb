"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path components, file names, suffixes and extensions that the file rules name.
IGNORED_DIRS = [".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "out", ".next", "__pycache__", ".venv", "venv", ".turbo", "coverage", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".idea", ".gradle", "target", "bin", "obj"]
IGNORED_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".map", ".lock"]
IGNORED_NAMES = ["pnpm-lock.yaml", "package-lock.json", "yarn.lock", "poetry.lock", "uv.lock"]
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go"}
MAX_READ_BYTES = 5 * 1024 * 1024
MAX_PARSE_BYTES = 2 * 1024 * 1024
MODULE_NAME = "<module>"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
ROLES = {"owner": 3, "admin": 2, "engineer": 1, "viewer": 0}
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def language_of(path: Column) -> Column:
    """The language of a path by its lower-case extension; null if unsupported."""
    out = F.lit(None).cast("string")
    for ext, lang in reversed(LANGUAGES.items()):
        out = F.when(F.lower(path).endswith(ext), F.lit(lang)).otherwise(out)
    return out


def is_ignored(path: Column) -> Column:
    """True for paths below an ignored directory and for ignored names or suffixes."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    out = F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS))) | name.isin(IGNORED_NAMES)
    for s in IGNORED_SUFFIXES:
        out = out | name.endswith(s)
    return out


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root, with ``/`` between its parts whatever they were divided by."""
    top = root.replace("\\", "/").rstrip("/") + "/"
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(plain)


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines() gives them: no empty last line after a final break."""
    parts = F.split(text, LINE_BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slug(text: Column, fallback: str = "project", most: int = 48) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    s = F.substring(s, 1, most)
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def free_slug(base: Column, taken: Column, salt: Column) -> Column:
    """``base``, or if it is taken, that and six hexadecimal digits of a hash of ``salt``."""
    return F.when(taken, F.concat(base, F.lit("-"), F.substring(F.sha2(salt.cast("string"), 256), 1, 6))).otherwise(base)


def with_token(url: Column, user: str, token: Column) -> Column:
    """An https address with credentials put before the host; other addresses stay. A slash at the end goes."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.when(bare.startswith("https://") & token.isNotNull(), F.concat(F.lit(f"https://{user}:"), token, F.lit("@"), F.regexp_replace(bare, "^https://(?:[^@/]*@)?", ""))).otherwise(bare)


def missing_models(required: Column, available: Column) -> Column:
    """Required names that aren't available; in both, a name without a tag means its latest."""
    tagged = lambda names: F.transform(names, lambda x: F.when(x.contains(":"), x).otherwise(F.concat(x, F.lit(":latest"))))
    return F.array_except(tagged(required), tagged(available))


def elapsed_ms(started: Column, finished: Column) -> Column:
    return F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID of a name, as uuid.uuid5 makes it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def node_id(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def identifier_parts(name: Column) -> Column:
    """``getUserById`` -> get, user, by, id and the identifier itself, lower-cased and distinct."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    words = F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")
    return F.array_distinct(F.concat(words, F.array(F.lower(name))))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-cased text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def risk_bucket(score: Column) -> Column:
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")


def problem_code(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "\\s+", "_")


def resource_type(url: Column) -> Column:
    """The first path segment after /api/v1/, up to a ``?``."""
    return F.regexp_extract(url, "/api/v1/([^/?]+)", 1)


def role_rank(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role)


def mask(text: Column) -> Column:
    """A log template: runs of digits become ``{*}``."""
    return F.regexp_replace(text, "[0-9]+", "{*}")


#: Shapes of secrets and their replacements.
SECRETS = (
    ("AKIA[0-9A-Z]{16}", "[aws-key]"),
    ("eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "[jwt]"),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "[private-key]"),
    ("ghp_[A-Za-z0-9]{36}", "[token]"),
)


def scrub(text: Column) -> Column:
    for pattern, new in SECRETS:
        text = F.regexp_replace(text, pattern, new)
    return text


#: Keys whose values are replaced, whatever their case, and what replaces them.
SENSITIVE_KEYS = ("authorization", "password", "token", "secret", "cookie", "api_key")
REDACTED = "[REDACTED]"


def redact(attributes: Column, keys: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """Values of sensitive keys of a map replaced."""
    return F.transform_values(attributes, lambda k, v: F.when(F.lower(k).isin(list(keys)), F.lit(REDACTED)).otherwise(v))
