"""Text expressions used by retrieval and extraction, all of them built-in functions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question shares with every other (fixed values).
STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "for", "of", "in", "on", "with", "how", "what", "where", "when", "why", "which", "show", "find", "list", "get", "give", "all", "from", "into", "that", "this", "these",
    "those", "does", "do", "is", "are", "be", "about", "please",
)


def split_camel(text: Column) -> Column:
    """camelCase words parted by spaces."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def search_tokens(text: Column, most: int = 6) -> Column:
    """The first distinct lower-case tokens of 3 or more letters, digits and signs of paths that are no stop words; null for null."""
    parts = F.split(F.lower(F.regexp_replace(split_camel(text), "[^a-zA-Z0-9_./-]+", " ")), " ")
    kept = F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of more than one character, repeats kept; null for null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for null vectors, NaN where one is zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return dot / F.sqrt(norm2(a) * norm2(b))


def norm2(a: Column) -> Column:
    """Squared length of a vector."""
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def clamp01(x: Column) -> Column:
    """x limited to 0..1; null and NaN become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def hex_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by the unit separator; null if any part is null."""
    joined = F.sha2(F.concat_ws("\x1f", *parts), 256)
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.left(joined, F.lit(16)))


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` components; ``..`` above the root is dropped."""
    empty = F.array().cast("array<string>")

    def step(done, part):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


#: Languages by ending (fixed values).
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",), "go": ("go",), "java": ("java",), "kotlin": ("kt", "kts"), "rust": ("rs",), "swift": ("swift",), "php": ("php",),
    "vue": ("vue",), "css": ("css", "scss", "less"), "html": ("html", "htm"), "markdown": ("md", "mdx"), "yaml": ("yml", "yaml"), "json": ("json",), "terraform": ("tf", "tfvars"), "sql": ("sql",),
}


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` for others."""
    extension = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
    out = F.lit("unknown")
    for language, endings in LANGUAGES.items():
        out = F.when(extension.isin(*endings), language).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB; null for null."""
    part = lambda power, digits, unit: F.concat(F.format_string(f"%.{digits}f", n / float(1 << power)), F.lit(f" {unit}"))
    return F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, part(10, 1, "KB")).when(n < 1 << 30, part(20, 1, "MB")).otherwise(part(30, 2, "GB"))


def human_age(seconds: Column) -> Column:
    """An age as one coarse unit; ``unknown`` for null, NaN and what lies ahead."""
    whole = lambda per, unit: F.concat(F.floor(seconds / per).cast("string"), F.lit(f"{unit} ago"))
    day = F.floor(seconds / 86400)
    months = F.concat(F.floor(day / 30).cast("string"), F.lit("mo ago"))
    known = F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).when(day < 30, whole(86400, "d"))
    known = known.when(F.floor(day / 30) < 12, months).otherwise(F.concat(F.floor(day / 365).cast("string"), F.lit("y ago")))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "unknown").otherwise(known)


def ellipsis(text: Column, most: int = 140) -> Column:
    """A text of at most ``most`` characters, the last of them a sign of omission where it was longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def truncated(text: Column, most: int, marker: str) -> Column:
    """A text of strictly at most ``most`` characters, ending in ``marker`` where it was longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(max(0, most - len(marker)))), F.lit(marker))).otherwise(text)


def range_days(text: Column) -> Column:
    """Days of a range such as 24h or 30d, from 1 to 365; 7 for anything else."""
    days = F.regexp_extract(F.trim(F.lower(text)), r"^(\d{1,4})d$", 1).try_cast("int")
    return F.when(F.trim(F.lower(text)) == "24h", 1).when(days.between(1, 365), days).otherwise(7)


def tolerant_json(text: Column) -> Column:
    """JSON out of an answer: the whole text, else a fenced block, else from the first brace to the last; null if none of them is JSON."""
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    fenced = F.trim(F.regexp_extract(text, r"(?is)```json\s*(.*?)```", 1))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(valid(F.trim(text)), valid(F.nullif(fenced, F.lit(""))), valid(F.nullif(braces, F.lit(""))))


def severity(word: Column) -> Column:
    """Severity of a finding as the index names it; ``low`` for unknown words."""
    low = F.lower(word)
    return F.when(low == "critical", "critical").when(low == "warning", "high").when(low == "suggestion", "medium").otherwise("low")


def coverage_verdict(total: Column, covered: Column) -> tuple[Column, Column]:
    """(percent, verdict) of a share: good from 80, ok from 50, else poor; no-methods where there is nothing."""
    nothing = total.isNull() | (total == 0)
    pct = F.when(nothing, 0).otherwise(F.floor(100 * covered / total + 0.5)).cast("int")
    return pct, F.when(nothing, "no-methods").when(pct >= 80, "good").when(pct >= 50, "ok").otherwise("poor")
