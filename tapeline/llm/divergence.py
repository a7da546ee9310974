"""Distribution divergence: documents whose character classes or common words lie far from every language.

Each document has a histogram of character classes and one of common words and all others. Common words are the most
frequent ones of each language, counted over all documents. The references are the histograms of all documents of a
language, summed; a document is rejected when the Jensen-Shannon distance from its own language's reference, and from
every other one, exceeds a threshold, provided that it is long enough for the distance to mean anything. Only DataFrame
and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored

MIN_WORDS = 50
#: Guard: characters that a document must have for the character distance; the word distance takes MIN_WORDS words.
MIN_CHARS = 200
#: A text of n words lies about WORD_NOISE / sqrt(n) from its own language by chance, which is added to its limit.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.30, 0.18, 1.4
#: Most frequent words taken of each language, of so many letters at most; of those, words of one in so many of its words.
COMMON, LETTERS, RARE = 24, 8, 1000
#: Marks that don't count as part of a common word.
MARKS = ".,;:!?"
#: Character classes of ASCII: lower case, upper case, digits, punctuation, symbols. White space and the bytes of
#: other characters beyond their first come as two more.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>")
#: The first of the letters that stand for common words in a document's trace: one byte for few words, three for many;
#: and the slots of their hash table.
FEW, MANY, SLOTS = 0x21, 0x4E00, 4096


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the array holds twice or more.

    A window is a long of a 36-bit hash and its place, so that sorting puts equal windows side by side. Windows of one
    hash count if their words are equal too: most are beside their like, and the others are looked for among all windows
    of the hash. Places are good for 134 million words.
    """
    low = (1 << 27) - 1

    def of(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        plain = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), window)
        # most texts' windows all differ
        return let(plain, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, coded)), found)))

    def coded(h: Column, i: Column) -> Column:
        # shifted left and right again, the hash keeps its low 36 bits and is not negative
        return F.shiftright(F.shiftleft(h, 28), 1).bitwiseAND(F.lit(~low & (2**63 - 1))).bitwiseOR(i.cast("long"))

    def found(s: Column) -> Column:
        code = lambda k: F.shiftright(F.get(s, k), 27)
        place = lambda k: F.get(s, k).bitwiseAND(F.lit(low)).cast("int")
        text = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        same = lambda a, b: (code(a) == code(b)) & (text(place(a)) == text(place(b)))
        beside = lambda k: F.coalesce(same(k, k + 1), F.lit(False)) | F.coalesce(same(k, F.when(k > 0, k - 1)), F.lit(False))
        near = lambda k: F.coalesce(code(k) == code(k + 1), F.lit(False)) | F.coalesce(code(k) == code(F.when(k > 0, k - 1)), F.lit(False))
        every = lambda k: F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j != k) & same(j, k))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: near(k) & (beside(k) | every(k)))
        return let(F.sort_array(F.transform(hits, place)), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def split_words(text: Column) -> Column:
    """Words of a text; none of null."""
    stripped = F.coalesce(F.btrim(text, F.lit(SPACES)), F.lit(""))
    # a separator at either end would give an empty word; the class is the six separators of SPACES
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"\s+", -1))


def bare(word: Column) -> Column:
    """A word in lower case and without the marks at its end."""
    return F.rtrim(F.lower(word), F.lit(MARKS))


def common_words(docs: DataFrame) -> list[tuple[str, int]]:
    """The ``COMMON`` most frequent words of each language and their slots, in order. What comes to the driver grows with
    the languages, not with the documents."""
    words = docs.where("lang IS NOT NULL").select("lang", F.explode(split_words(F.col("text"))).alias("word")).select("lang", bare(F.col("word")).alias("word")).where(F.char_length("word") <= LETTERS)
    counts = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # of the words that may be common
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON)
    return sorted((r[0], r[1]) for r in ranked.join(totals, "lang").where((F.col("n") * RARE >= F.col("total")) & (F.col("word") != "")).select("word", slot("word")).distinct().collect())


def slot(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def word_histogram(words: Column, common: list[tuple[str, int]]) -> Column:
    """How often each common word comes, and all other words together.

    A word's slot names the common word that it may be; those are written as a trace of letters, whose counts are what
    the trace loses without each letter."""
    table, late = [-1] * SLOTS, []
    for k, (_, at) in enumerate(common):
        if table[at] < 0:
            table[at] = k
        else:
            late.append(k)
    first, width = (FEW, 1) if len(common) < 90 else (MANY, 3)
    letter = lambda k: chr(first + k)
    slots, known, letters = (F.lit(x) for x in (table, [w for w, _ in common] or [""], [letter(k) for k in range(len(common))] or [""]))

    def of(w: Column) -> Column:
        k = F.get(slots, slot(w))
        out = F.when((k >= 0) & (F.get(known, k) == w), F.get(letters, k))
        for other in late:  # whose slot another has
            out = out.when(w == common[other][0], letter(other))
        return out

    trace = F.array_join(F.transform(F.transform(words, bare), of), "")
    size = lambda x: F.octet_length(x) / F.lit(float(width))
    counts = lambda t: F.array(*[size(t) - size(F.replace(t, F.lit(letter(k)), F.lit(""))) for k in range(len(common))], F.size(words) - size(t))
    return let(trace, counts)


def features(docs: DataFrame, common: list[tuple[str, int]]) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms."""
    base = docs.select("doc_id", F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("t"), split_words(F.col("text")).alias("words"))
    text_lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # one letter stands for each class
    groups = [*CLASSES, SPACES]
    signs = [c[0] for c in groups]
    mapped = F.translate("t", "".join(groups), "".join(sign * len(c) for sign, c in zip(signs, groups, strict=True)))
    counted = let(mapped, lambda m: F.array(*[(F.octet_length(m) - F.octet_length(F.replace(m, F.lit(sign), F.lit("")))).cast("double") for sign in signs], (F.octet_length(m) - F.char_length(m)).cast("double")))
    base = base.select("*", counted.alias("char_hist"), text_lines.alias("lines"))
    symbols, space = F.get("char_hist", F.lit(len(CLASSES) - 1)), F.get("char_hist", F.lit(len(CLASSES)))
    return base.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), (F.char_length("t") - space).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        "char_hist", word_histogram(F.col("words"), common).alias("word_hist"),
    )


def total(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda x, y: x + y)


def distribution(h: Column) -> Column:
    return let(total(h), lambda n: F.transform(h, lambda x: F.try_divide(x, n)))


def entropy(p: Column) -> Column:
    """In bits."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)))


def distance(p: Column, entropy_p: Column, ref: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of a distribution from a reference, a struct of
    its distribution p and entropy h."""
    middle = F.zip_with(p, ref["p"], lambda a, b: (a + b) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), entropy(middle) - (entropy_p + ref["h"]) / 2))


def references(found: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row: the languages, and for each histogram column, of the size given, their sums as distributions (p, h)."""
    sums = [F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)]).alias(c) for c, n in sizes.items()]
    by_lang = found.where("lang IS NOT NULL").groupBy("lang").agg(*sums)
    # a reference without any count is null, and so is the distance from it
    shares = lambda c: F.when(total(F.col(c)) > 0, let(distribution(F.col(c)), lambda p: F.struct(p.alias("p"), entropy(p).alias("h")))).alias(c)
    return by_lang.agg(F.collect_list(F.struct("lang", *[shares(c) for c in sizes])).alias("refs"))


def nearest(h: Column, column: str, limit: Column) -> Column:
    """Distance from the document's own language if it is within the limit, else from the nearest of all."""

    def of(p: Column, entropy_p: Column) -> Column:
        far = lambda r: distance(p, entropy_p, r[column])
        own = far(F.get(F.filter("refs", lambda r: r["lang"] == F.col("lang")), F.lit(0)))
        return let(own, lambda d: F.when(d <= limit, d).otherwise(F.coalesce(F.array_min(F.transform("refs", far)), F.lit(0.0))))

    return let(distribution(h), lambda p: let(entropy(p), lambda e: of(p, e)))


def quality_rules(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance.

    A null or empty text has no words and fails the base rules. A document without language is judged like any
    other and adds to no reference. Every language has a reference and common words of its own; the work for a document
    grows with the number of common words. Distances are null under the guards' lengths, and then don't reject. Without
    references nothing is rejected beyond the base rules. Very long texts are read whole, in memory in proportion to
    their words. Equal rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    common = common_words(docs)
    found = stored(features(docs, common))
    # a row of sums for each language, all of them in the row that is joined to each document
    found = found.crossJoin(F.broadcast(stored(references(found, {"char_hist": len(CLASSES) + 2, "word_hist": len(common) + 1}))))
    word_limit = max_word + WORD_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    by_char_d = F.when(total(F.col("char_hist")) >= MIN_CHARS, nearest(F.col("char_hist"), "char_hist", F.lit(max_char)))
    by_word_d = F.when(F.col("n_words") >= MIN_WORDS, nearest(F.col("word_hist"), "word_hist", word_limit))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = found.withColumn("base_failed", failed).withColumn("char_distance", by_char_d).withColumn("word_distance", by_word_d)
    kept = ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")
