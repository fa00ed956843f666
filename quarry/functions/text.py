"""Text functions as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_words(text: Column) -> Column:
    """Lower-cased white-space words, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def long_words(text: Column, longer_than: int = 3) -> Column:
    """Distinct lower-cased words longer than so many characters; punctuation stays."""
    return F.array_distinct(F.filter(lower_words(text), lambda w: F.length(w) > longer_than))


def content_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct maximal runs of letters, digits and underscores that are all ASCII letters and digits, at least four long."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z0-9]{4,}$")))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def share_contained(words: Column, context: Column) -> Column:
    """Share of words that occur in context as substrings; 1 when there are none."""
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.contains(context, w))) / F.size(words))


def _pack(parts: Column, separator: str, limit: int) -> Column:
    """Left fold: joins parts while the result has at most ``limit`` characters. struct<done, open>; open is null at the start."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, part: Column) -> Column:
        joined = F.concat(s["open"], F.lit(separator), part)
        fits = F.length(joined) <= limit
        return F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), part.alias("open"))).when(fits, F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), part.alias("open")))

    return F.aggregate(parts, start, step)


def chunk_markdown(text: Column, limit: int = 800, least: int = 20) -> Column:
    """Chunks of a markdown text, in order.

    Paragraphs are packed with blank lines between them up to ``limit`` characters; a longer paragraph is cut into
    sentences, which are packed with single spaces, its last segment staying open for what follows; a longer sentence
    stays whole. Chunks of at most ``least`` characters are dropped at the end.
    """
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    paragraphs = F.filter(F.transform(F.split(unix, r"\n{2,}"), _strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flush(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        cut = _pack(F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda x: x != ""), " ", limit)
        whole = F.struct(flush(s).alias("done"), p.alias("open"))
        # through an array of one, so that the sentences are packed once for both fields
        long = F.get(F.transform(F.array(cut), lambda c: F.struct(F.concat(flush(s), c["done"]).alias("done"), F.coalesce(c["open"], F.lit("")).alias("open"))), F.lit(0))
        return F.when(F.length(joined) <= limit, F.struct(s["done"].alias("done"), joined.alias("open"))).when(F.length(p) <= limit, whole).otherwise(long)

    return F.filter(F.aggregate(paragraphs, start, step, flush), lambda c: F.length(_strip(c)) > least)


def chunk_page(text: Column, limit: int = 800) -> Column:
    """Chunks of one page: paragraphs packed up to ``limit``; no sentence is cut and nothing is dropped for being short."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    paragraphs = F.filter(F.transform(F.split(unix, r"\n{2,}"), _strip), lambda p: p != "")
    packed = _pack(paragraphs, "\n\n", limit)
    return F.when(packed["open"].isNull(), packed["done"]).otherwise(F.array_append(packed["done"], packed["open"]))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def section_header(text: Column, page: Column) -> Column:
    """The first non-blank line if it is a heading (``#``) or a short line in capitals, in title case or ending in a colon;
    else the next such line; else the page's number."""
    lines = F.filter(F.transform(F.split(text, "\n"), _strip), lambda x: x != "")
    letters = lambda x: F.regexp_replace(x, r"\P{L}", "")
    capitals = lambda x: (letters(x) != "") & (x == F.upper(x))
    title = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"(^|\P{L})\p{Ll}|\p{L}\p{Lu}")
    heads = F.filter(lines, lambda x: x.startswith("#") | ((F.length(x) < 60) & (capitals(x) | title(x) | x.endswith(":"))))
    first = F.get(heads, F.lit(0))
    said = F.when(first.startswith("#"), _strip(F.regexp_replace(first, "^#+", ""))).otherwise(F.regexp_replace(first, ":+$", ""))
    return F.coalesce(said, F.concat(F.lit("Section Page "), page.cast("string")))


def typos(text: Column, key: Column, seed: int = 0) -> Column:
    """A perturbed text, always the same for a key and seed: of texts with two words or more, up to two words longer than
    four characters get an inner letter swapped, deleted or doubled."""
    words = F.split(_strip(text), r"\s+")
    eligible = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.length(F.get(words, i)) > 4)
    draw = lambda salt, i: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(salt), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    order = F.array_sort(F.transform(eligible, lambda i: F.struct(draw("1", i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, 2), lambda x: x["i"])

    def edit(w: Column, i: Column) -> Column:
        at = (1 + F.pmod(draw("2", i), F.length(w) - 2)).cast("int")  # 0-based, an inner letter
        kind = F.pmod(draw("3", i), F.lit(3))
        a, b, c, d = F.substring(w, F.lit(1), at), F.substring(w, at + 1, F.lit(1)), F.substring(w, at + 2, F.lit(1)), F.substring(w, at + 3, F.length(w))
        return F.when(kind == 0, F.concat(a, c, b, d)).when(kind == 1, F.concat(a, c, d)).otherwise(F.concat(a, b, b, c, d))

    changed = F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(chosen, i), edit(w, i)).otherwise(w)), " ")
    return F.when((F.size(words) < 2) | (F.size(eligible) == 0), text).otherwise(changed)
