"""Line dedup by a deletion-neighbourhood join: repeated and nearly repeated lines go, the earliest stays.

DataFrame functions only. The edit unit is a word and the bound is one edit. A line that isn't blank is removed if an earlier line (smaller doc_id, or
same document and smaller line number) equals it; a line of at least ``min_words`` words also if an earlier one of at least so many differs from it by
one word put in, left out or replaced (of fewer words, one is too much to be a near copy). Lines are judged on the input, not on what is left.

1. Equal lines meet by 128 bits of hash; one distinct line stands for all its copies from here on.
2. One edit falls into one of three parts of a line and leaves what stands before and after that part. Lines that share such a rest, by hashed
   keys, with no other distinct line have no neighbour; they need no variants, and others need those of the shared parts only.
3. Every line that is left emits its deletion neighbourhood as hashed keys: what stands before and after its i-th word (the line without that
   word), and what stands before and after each gap (the line that a longer one becomes without a word). Equal keys of the first kind tell
   of a word replaced, of different kinds of a word put in or left out. Words before and after are hashed in chained blocks, so the keys of a
   line cost its length and not the square of it. Nothing is paired: a key needs its earliest line of either kind only, so a variant shared
   by a third of all lines costs one row a line.
4. Each line and the earliest neighbour found by each key are compared word by word before the line is removed.

Texts are shuffled only for documents, and lines only where they are, that a bitmap lists; it grows with its keys up to a bound, so it may be sent to
all tasks. It lists a few too many, never too few. Lines with very many copies (there are ``HOT`` such lines at most) are sent to all tasks, not gathered.

Defined results: a null or empty text has no lines removed; blank lines always stay. Rows that repeat a doc_id count as
the same place, so they don't remove one another's lines. Null doc_ids come last. Other columns are left as they are. No rows in, none out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import SPACES, let, maybe_among, settled, table

MIN_WORDS = 5
PARTS = 3
BLOCK = 32
HOT = 10_000
GONE = "__gone_lines"
#: SQL for the place of a null doc_id: after all others.
LATE = "cast('9223372036854775808' as decimal(20,0))"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def canonical(line: Column) -> Column:
    """The words of a line joined by single spaces."""
    odd = line.rlike(r"[\x09-\x0D]|\x20\x20")
    return F.trim(F.when(odd, F.regexp_replace(line, SPACES, " ")).otherwise(line))


def part_keys(line: Column, n: Column) -> Column:
    """Keys of what an edit leaves when it falls into one of three parts: as the shorter of two lines or of the same length (codes 0 to 2), and as the longer one (3 to 5). The code is in the lowest three bits."""

    def key(m: Column, part: int, code: int) -> Column:
        before, after = part_start(m, part), m - part_start(m, part + 1)
        piece = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
        return F.shiftleft(F.xxhash64(m, F.lit(part), piece(before), piece(-after)), 3) + code

    return F.array(*(key(n - longer, part, 3 * longer + part) for longer in (0, 1) for part in range(PARTS)))


def part_start(m: Column, part: int | Column) -> Column:
    return F.floor(m * part / PARTS).cast("int")


def place_of(doc_id: Column, line_no: Column) -> Column:
    """One number that orders lines by document, nulls last, and line."""
    return (F.coalesce(doc_id.cast("decimal(20,0)"), F.expr(LATE)) * F.lit(1 << 32).cast("decimal(10,0)") + line_no).cast("decimal(38,0)")


def heads(words: Column) -> Column:
    """Hashes of no words, the first, the first two and so on: whole blocks of words are chained, and what is left of a block is hashed behind them. Linear in the words, but for the short chain of blocks."""
    step = lambda i: F.floor(i / BLOCK).cast("int")

    def of(words: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), step(F.size(words))), lambda k: F.xxhash64(F.slice(words, k * BLOCK + 1, BLOCK)))
        chain = F.aggregate(whole, F.array(F.lit(42).cast("long")), lambda a, h: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), h))))
        rest = lambda i: F.slice(words, step(i) * BLOCK + 1, i - step(i) * BLOCK)
        return let(chain, lambda c: F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.xxhash64(F.get(c, step(i)), rest(i))))

    return let(words, of)


def within_one_word(a: Column, b: Column) -> Column:
    """Whether the arrays differ by one word put in, left out or replaced, or not at all: common head and tail cover all but one word."""
    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    differs = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: ~v.eqNullSafe(w)), True)
    alike = lambda x, y: F.when(differs(x, y) == 0, longest).otherwise(differs(x, y) - 1)
    return (longest - shortest <= 1) & (alike(a, b) + alike(F.reverse(a), F.reverse(b)) >= longest - 1)


def canonical_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, n, h1) of every line that isn't blank: its words joined by single spaces, their number and a hash."""
    # Made canonical before they are exploded, so that no filter does it again.
    split = docs.select("doc_id", F.posexplode(F.transform(text_lines(F.col("text")), canonical)).alias("line_no", "line")).where("line <> ''")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return split.select("doc_id", "line_no", "line", n.cast("int").alias("n"), F.xxhash64("line").alias("h1"))


def distinct_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, place, copies, k0 to k5): every distinct line with its first place, its number and its part keys (null for lines of fewer than min_words words)."""
    lines = canonical_lines(docs)
    keys = F.when(F.col("n") >= min_words, part_keys(F.col("line"), F.col("n")))
    keyed = lines.select("h1", F.xxhash64(F.lit(7), "line").alias("h2"), place_of(F.col("doc_id"), F.col("line_no")).alias("place"), keys.alias("keys"))
    return settled(
        keyed.select("h1", "h2", "place", *(F.get("keys", F.lit(k)).alias(f"k{k}") for k in range(2 * PARTS)))
        .groupBy("h1", "h2")
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), *(F.min(f"k{k}").alias(f"k{k}") for k in range(2 * PARTS)))
    )


def near_candidates(docs: DataFrame, uniq: DataFrame) -> DataFrame:
    """(place, codes, words) of the distinct lines that share what one edit would leave of them with another one; codes: in which parts."""
    coded = F.explode(F.array(*(F.col(f"k{k}") for k in range(2 * PARTS)))).alias("coded")
    pieces = uniq.where("k0 is not null").select("h1", "place", coded).select("h1", "place", F.call_function("shiftright", F.col("coded"), F.lit(3)).alias("key"), F.col("coded").bitwiseAND(7).cast("int").alias("code"))
    shared = settled(pieces.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(F.col("key").alias("d")))
    met = maybe_among(pieces, shared, "key")[0].join(shared, F.col("key") == F.col("d"), "left_semi")
    chosen = settled(met.groupBy(F.col("h1").alias("d"), F.col("place").alias("p")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("code"))).alias("codes")))
    # The words of the chosen lines, read again; of all others the bitmap lists few.
    listed = maybe_among(canonical_lines(docs).select("h1", place_of(F.col("doc_id"), F.col("line_no")).alias("place"), "line"), chosen, "h1")[0]
    own = listed.join(chosen.hint("merge"), (F.col("h1") == F.col("d")) & (F.col("place") == F.col("p")))
    return settled(own.dropDuplicates(["place"]).select("place", "codes", F.split("line", " ").alias("words")))


def variants(lines: DataFrame) -> DataFrame:
    """(place, cut, k1, k2): the neighbourhood of lines (place, codes, words). Each line without its i-th word (cut 1), and each line with a gap before its i-th word (cut 0), as what stands before and after; in the parts that the codes name."""
    n = F.size("words")
    flags = F.filter(F.sequence(F.lit(0), F.lit(3 * PARTS - 1)), lambda c: F.call_function("shiftright", F.col("codes"), c % (2 * PARTS)).bitwiseAND(1) == 1)

    def of(pre: Column, suf: Column, code: Column) -> Column:
        m = n - F.when(code.between(PARTS, 2 * PARTS - 1), 1).otherwise(0)
        cut = (code < 2 * PARTS).cast("int")
        # Gaps, and words left out of the longer line, may stand at the end of a part.
        start, last = part_start(m, code % PARTS) + 1, F.least(part_start(m, code % PARTS + 1) + F.when(code < PARTS, 0).otherwise(1), n + 1 - cut)
        spots = F.coalesce(F.when(start <= last, F.sequence(start, last)), F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(cut.alias("cut"), F.xxhash64(i, n - cut, F.get(pre, i - 1)).alias("k1"), F.get(suf, n - i + 1 - cut).alias("k2")))

    made = let(heads(F.col("words")), lambda pre: let(heads(F.reverse("words")), lambda suf: F.flatten(F.transform(flags, lambda code: of(pre, suf, code)))))
    return lines.select("place", F.explode(made).alias("v")).select("place", "v.*")


def near_lines(lines: DataFrame) -> DataFrame:
    """(p): the places of lines (place, codes, words) that differ by one word from an earlier one."""
    made = variants(lines)
    met = F.min("place").alias("any"), F.min(F.when(F.col("cut") == 1, F.col("place"))).alias("of_cut"), F.max("place").alias("last")
    first = settled(made.groupBy("k1", "k2").agg(*met).where("any <> last and of_cut is not null").select(F.col("k1").alias("d"), F.col("k2").alias("e"), "any", "of_cut"))
    joined = maybe_among(made, first, "k1")[0].join(first, (F.col("k1") == F.col("d")) & (F.col("k2") == F.col("e")))
    pairs = joined.select("place", F.when(F.col("cut") == 1, F.col("any")).otherwise(F.col("of_cut")).alias("other")).where("other < place").distinct()
    words = lines.select("place", "words")
    seen = pairs.join(words, "place").join(words.select(F.col("place").alias("other"), F.col("words").alias("their")), "other")
    return settled(seen.where(within_one_word(F.col("words"), F.col("their"))).select(F.col("place").alias("p")).distinct())


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no): the lines that go."""
    docs = docs.select("doc_id", "text")
    uniq = distinct_lines(docs, min_words)
    near = near_lines(near_candidates(docs, uniq))
    going = uniq.select("h1", "h2", "place", "copies").join(near, F.col("place") == F.col("p"), "left").where("copies > 1 or p is not null")
    going = settled(going.select(F.col("h1").alias("d"), F.col("h2").alias("e"), F.col("place").alias("first"), "copies", F.col("p").isNotNull().alias("all")))
    lines = canonical_lines(docs).select("doc_id", "line_no", "h1", F.xxhash64(F.lit(7), "line").alias("h2"), place_of(F.col("doc_id"), F.col("line_no")).alias("place"))
    listed = maybe_among(lines, going, "h1")[0]
    # Lines with more copies than that are HOT at most, so they may be sent to all tasks; their copies then stay where they are.
    often = int(uniq.agg(F.sum("copies")).first()[0] or 0) // HOT + 1
    same = (F.col("h1") == F.col("d")) & (F.col("h2") == F.col("e"))
    hot = listed.join(F.broadcast(going.where(F.col("copies") > often)), same)
    rest = listed.join(going.where(F.col("copies") > often).select("d", "e").hint("broadcast"), same, "left_anti").join(going.where(F.col("copies") <= often), same)
    return hot.unionByName(rest).where(F.col("all") | (F.col("place") > F.col("first"))).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_removed", "kept")) -> DataFrame:
    """docs with three more columns: the number of lines, that of the lines that go, and the text without them."""
    gone = settled(repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("line_no").alias("gone_lines")))
    every = text_lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(GONE))
    kept = let(every, lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    listed, rest = maybe_among(docs, gone)
    lines = gone.select(F.col("d").alias(f"{GONE}_id"), F.col("gone_lines").alias(GONE)).hint("merge")  # grows with the corpus
    some = listed.join(lines, F.col("doc_id").eqNullSafe(F.col(f"{GONE}_id")), "left").drop(f"{GONE}_id")
    return (
        some.unionByName(rest.withColumn(GONE, F.lit(None).cast("array<int>")))
        .withColumn(names[0], F.size(every).cast("long"))
        .withColumn(names[1], F.coalesce(F.size(GONE), F.lit(0)).cast("long"))
        .withColumn(names[2], F.when(F.col(GONE).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
        .drop(GONE)
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
