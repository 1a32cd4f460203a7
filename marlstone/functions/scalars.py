"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidPath
from ..schema import ENTRY_TYPES, KINDS

# Character ranges that are cut into overlapping pairs (Han and its
# extension A and compatibility forms, Hiragana, Katakana, Hangul syllables).
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF))
CJK_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
TOKEN_PATTERN = f"[a-z0-9]+|[{CJK_CLASS}]+"

# Field weights, BM25 and fusion constants, number of index buckets.
TITLE_WEIGHT, TAGS_WEIGHT, BODY_WEIGHT = 3, 2, 1
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
BUCKETS = 64

SUMMARY_CHARS, SHORT_CHARS, DESCRIPTION_CHARS = 120, 16, 512


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# addresses


def address(data: Column | str) -> Column:
    """Content address of bytes or text."""
    return F.concat(F.lit("sha256:"), F.sha2(col(data).cast("binary"), 256))


def is_address(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def short_address(c: Column | str) -> Column:
    return F.substring(col(c), 1, SHORT_CHARS)


def merge_short(c: Column | str) -> Column:
    """Prefix and eight hex digits."""
    return F.substring(col(c), 1, len("sha256:") + 8)


def is_kind(c: Column | str) -> Column:
    return col(c).isin(*KINDS)


def is_entry_type(c: Column | str) -> Column:
    return col(c).isin(*ENTRY_TYPES)


# text


def folded(text: Column | str) -> Column:
    """Lower case; dotted capital I becomes a plain i."""
    return F.lower(F.translate(col(text), "İ", "i"))


def tokens(text: Column | str) -> Column:
    """Tokens in order: runs of a-z and 0-9, and pairs (or a lone character) of CJK runs."""
    text = folded(F.coalesce(col(text), F.lit("")))
    runs = F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike("^[a-z0-9]") | (F.char_length(run) == 1), F.array(run)).otherwise(pairs)

    # Where there is no CJK, the runs are the tokens.
    return F.when(text.rlike(f"[{CJK_CLASS}]"), F.flatten(F.transform(runs, cut))).otherwise(runs)


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.hex(F.encode(col(text), "UTF-8"))
    values = F.transform(
        F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"),
    )
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def bucket(text: Column | str) -> Column:
    """FNV-1a modulo BUCKETS, a power of two, so that only the low bits of each step count. For up to 12 ASCII characters,
    which nearly all terms are, the steps are written out: functions over arrays cost more than cutting the text into terms."""
    text, low = col(text), BUCKETS - 1
    h = F.lit(2166136261 & low)
    for i in range(1, 13):  # past the end: xor by 0, times 1
        h = (h.bitwiseXOR(F.ascii(F.substring(text, i, 1))) * F.when(F.octet_length(text) >= i, F.lit(16777619 & low)).otherwise(F.lit(1))).bitwiseAND(F.lit(low))
    short = (F.octet_length(text) == F.char_length(text)) & (F.octet_length(text) <= 12)
    return F.when(short, h).otherwise((fnv1a(text) % BUCKETS).cast("int"))


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def summary(body: Column | str) -> Column:
    """First line that isn't blank, trimmed, cut after 120 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(body), F.lit("")), "\n"), trimmed), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.char_length(line) > SUMMARY_CHARS, F.concat(F.substring(line, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(line)


def embed_text(title: Column | str, body: Column | str) -> Column:
    return F.concat(col(title), F.lit("\n\n"), col(body))


def tags_or_empty(tags: Column | str) -> Column:
    return F.coalesce(col(tags), F.array().cast("array<string>"))


def tags_equal(a: Column | str, b: Column | str) -> Column:
    """Equality of the sorted tags; none equals empty."""
    return F.array_sort(tags_or_empty(a)) == F.array_sort(tags_or_empty(b))


def split_tags(text: Column | str) -> Column:
    """Comma-separated tags, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col(text), ","), trimmed), lambda x: x != "")


def log_time(seconds: Column | str) -> Column:
    """Time as text; the session's zone, which the engine sets to UTC."""
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd HH:mm:ss")


# paths


def path_parts(path: str) -> list[str]:
    """Segments of a path; blank text is the root."""
    if not path.strip():
        return []
    parts = path.split("/")
    for part in parts:
        if not part.strip() or part in (".", ".."):
            raise InvalidPath(f"bad segment {part!r} in {path!r}")
    return parts


def note_path(path: str) -> str:
    if not path_parts(path):
        raise InvalidPath("a note needs a path")
    return path


def valid_path(path: Column | str) -> Column:
    parts = F.split(col(path), "/")
    return F.coalesce(~F.exists(parts, lambda p: (trimmed(p) == "") | p.isin(".", "..")), F.lit(False))


def slug_of(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent_of(path: Column | str) -> Column:
    """Path of the directory; the root is the empty text."""
    parts = F.split(col(path), "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def depth_of(path: Column | str) -> Column:
    return F.size(F.split(col(path), "/"))


def ancestors_of(path: Column | str) -> Column:
    """All directories above a path, the root left out."""
    parts = F.split(col(path), "/")
    some = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(some, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def in_dir(path: Column | str, directory: str) -> Column:
    """Below a directory, at any depth."""
    return F.lit(True) if not path_parts(directory) else col(path).startswith(directory + "/")


def tree_order(path: Column | str) -> Column:
    """Sort key of listings: depth first, by segment."""
    return F.split(col(path), "/")


# scores


def weighted(title: Column | str, tags: Column | str, body: Column | str) -> Column:
    return TITLE_WEIGHT * col(title) + TAGS_WEIGHT * col(tags) + BODY_WEIGHT * col(body)


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def rrf(rank: Column | str) -> Column:
    return F.lit(1.0) / (RRF_K + col(rank))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sequential double sum over the shorter length."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    pairs = F.zip_with(F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity over the shorter length; a zero vector gives 0."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n)
    norms = dot(x, x) * dot(y, y)
    return F.when(norms == 0, 0.0).otherwise(dot(x, y) / F.sqrt(norms))


def positive_limit(value: int | str | None) -> int | None:
    """A limit given by a caller; none means all."""
    if value is None or value == "":
        return None
    n = int(value)
    if n <= 0:
        raise ValueError(f"a limit must be positive, not {value}")
    return n
