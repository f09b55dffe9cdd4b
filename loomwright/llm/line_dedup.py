"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions only.

A line is compared by its words: lower case, white space folded. It is a duplicate when an earlier line
(by doc_id, then place) is equal, or differs by one word changed, added or left out and both have at
least ``MIN_WORDS`` words. Blank lines are never duplicates.

Equal lines are folded first. Of the distinct lines, only those go on that share their first or last
half with another one, as every pair within the bound does. Each of them emits its variants with one
word deleted and itself, as hashed keys that come from running sums over its words, so the cost is
linear in its length. Groups of equal variants keep their earliest line, which each other member is
checked against word by word; no pairs within a group are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

MIN_WORDS = 5
#: Most documents whose wanted lines are broadcast, about 64 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_BLANKS = " \t\r\f"


def fold(line: Column) -> Column:
    """The words of a line, in lower case and with single spaces; the pattern runs only where it has work."""
    low = F.lower(line)
    uneven = F.contains(low, F.lit("  ")) | F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\f"))
    return F.trim(F.when(uneven, F.regexp_replace(low, f"[{_BLANKS}]+", " ")).otherwise(low))


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, place, folded) of every line that is not blank."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_key().alias("text_key"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # Blank lines are told by the line itself: a condition on the folded line would be folded a second time.
    return rows.where(F.ltrim("line", F.lit(_BLANKS)) != "").select("doc_id", "text_key", "place", fold(F.col("line")).alias("folded"))


def _n_words(folded: str) -> Column:
    return F.octet_length(folded) - F.octet_length(F.replace(F.col(folded), F.lit(" "), F.lit(""))) + 1


def _half_keys(min_words: int) -> Column:
    """The keys of a line of ``n`` words by its first and last words.

    Two lines within one edit, the shorter of m words, share the first q(m) or the last q(m) words, as
    2 q(m) <= m. A line can be the shorter one (m = n) or the longer (m = n - 1). q(m) is m / 2 with all
    but its two leading bits cleared, so that few lengths are in use.
    """

    def pair(q: str) -> str:
        return f"xxhash64('first', {q}, substring_index(folded, ' ', {q})), xxhash64('last', {q}, substring_index(folded, ' ', -{q}))"

    return F.expr(f"CASE WHEN n < {min_words} THEN cast(array() as array<bigint>) WHEN q0 = q1 THEN array({pair('q0')}) ELSE array({pair('q0')}, {pair('q1')}) END")


def _half(m: str) -> Column:
    half = f"(({m}) div 2)"
    return F.expr(f"cast({half} - {half} % shiftleft(1, greatest(length(bin({half})) - 2, 0)) as int)")


def _variants(likely: DataFrame) -> DataFrame:
    """(line, key, length, tag): each line itself (tag -1) and without its word ``tag``.

    The key of a word sequence is the xor of the hashes of (word, place). Running xors over the words,
    with the places as they are and as they are after a deletion, give all variants in linear time.
    """
    words = likely.select("line", F.posexplode(F.split("folded", " ")).alias("i", "word"), "n").withColumn("hash", F.xxhash64("word")).drop("word")
    line = Window.partitionBy("line")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here, moved = F.xxhash64("hash", F.col("i")), F.xxhash64("hash", F.col("i") - 1)
    sums = words.select("line", "i", "n", F.bit_xor(here).over(upto).alias("head"), here.alias("own"), F.bit_xor(moved).over(upto).alias("past"), F.bit_xor(moved).over(line).alias("all_moved"), F.bit_xor(here).over(line).alias("all"))
    xor = lambda *c: F.expr(" ^ ".join(c))
    deleted = F.struct(xor("head", "own", "past", "all_moved").alias("key"), (F.col("n") - 1).alias("length"), F.col("i").alias("tag"))
    whole = F.struct(F.col("all").alias("key"), F.col("n").alias("length"), F.lit(-1).alias("tag"))
    rows = sums.select("line", F.explode(F.when(F.col("i") == 0, F.array(deleted, whole)).otherwise(F.array(deleted))).alias("v"))
    return rows.select("line", "v.*")


def near_lines(likely: DataFrame) -> DataFrame:
    """``first`` of each line that an earlier one comes within one word of.

    ``likely`` has (line, first, n, folded), a row per distinct line; ``first`` is its earliest place.
    """
    variants = _variants(likely)
    # What is joined back comes from checkpoints: both sides are then shuffled for the join, and a hot variant can be split.
    met = cut(variants.groupBy("key", "length").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key", "length"))
    rows = cut(variants.join(met, ["key", "length"]).join(likely.select("line", "first"), "line").select("key", "length", "tag", "first"))
    by_place = cut(rows.groupBy("key", "length", "tag").agg(F.min("first").alias("same")))
    by_key = cut(by_place.groupBy("key", "length").agg(F.min(F.when(F.col("tag") < 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("tag") >= 0, F.struct("same", "tag"))).alias("cut")))
    offers = rows.join(by_place, ["key", "length", "tag"]).join(by_key, ["key", "length"])
    offer = lambda at, tag: F.struct(at.alias("other"), tag.alias("other_tag"))
    none = F.lit(-1)
    offers = offers.select(
        "first", "tag",
        F.explode(F.when(F.col("tag") >= 0, F.array(offer(F.col("same"), F.col("tag")), offer(F.col("whole"), none))).otherwise(F.array(offer(F.col("cut.same"), F.col("cut.tag"))))).alias("o"),
    ).select("first", "tag", "o.*").where("other < first").distinct()
    text = likely.select("first", F.split("folded", " ").alias("words"))
    pairs = offers.join(text, "first").join(text.select(F.col("first").alias("other"), F.col("words").alias("other_words")), "other")
    minus = lambda w, t: F.when(F.col(t) < 0, F.col(w)).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(F.col(t), F.lit(0))), F.slice(w, F.greatest(F.col(t), F.lit(0)) + 2, F.size(w))))
    return pairs.where(minus("words", "tag") == minus("other_words", "other_tag")).select("first").distinct()


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, places): the places of the lines that each document loses, if any.

    Lines are held in 128 bits of hash. Of rows with one doc_id the order is that of their text keys.
    """
    hashed = lines_of(docs).withColumn("n", _n_words("folded")).withColumn("q0", _half("n")).withColumn("q1", _half("n - 1"))
    slim = cut(hashed.select("doc_id", "text_key", "place", "n", F.xxhash64("folded").alias("h1"), F.xxhash64(F.lit(7), "folded").alias("h2"), _half_keys(min_words).alias("keys")))
    keyed = slim.select("h1", F.explode("keys").alias("key"))
    # From a checkpoint, so that both sides of the join are shuffled for it and a hot key can be split.
    shared = cut(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"))
    likely_hashes = keyed.join(shared, "key").groupBy("h1").agg(F.lit(True).alias("likely"))
    distinct = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    distinct = cut(distinct.join(likely_hashes, "h1", "left").where("rows > 1 OR likely"))
    # The earliest place of the lines that still matter, looked up in the earliest document only: a join that also has
    # doc_id among its keys spreads the copies of a common line.
    at = F.struct("doc_id", "text_key", "place")
    places = slim.select("h1", "h2", "doc_id", "text_key", "place").join(distinct, ["h1", "h2", "doc_id"]).groupBy("h1", "h2").agg(
        F.min(at).alias("first"), F.max("rows").alias("rows"), F.max("likely").alias("likely")
    )
    firsts = cut(places)
    likely = cut(_texts_of(docs, firsts.where("likely")).withColumn("line", F.monotonically_increasing_id()))
    near = near_lines(likely).withColumn("near", F.lit(True))
    losing = firsts.join(near, "first", "left").where("rows > 1 OR near").select("h1", "h2", "first", "near")
    gone = slim.join(losing, ["h1", "h2"]).where(F.col("near").isNotNull() | (at != F.col("first")))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def _texts_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(first, n, folded) of the lines at the places ``first``; only they are folded again."""
    wanted = firsts.groupBy(F.col("first.doc_id").alias("of_doc"), F.col("first.text_key").alias("of_text")).agg(F.collect_list("first.place").alias("wanted"))
    if firsts.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_key().alias("text_key"), "text")
    rows = texts.join(wanted, (F.col("doc_id") == F.col("of_doc")) & (F.col("text_key") == F.col("of_text")))
    picked = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda i: F.struct(i.alias("place"), F.get(lines, i).alias("line"))))
    rows = rows.select("doc_id", "text_key", F.explode(picked[0]).alias("w")).select(F.struct("doc_id", "text_key", "w.place").alias("first"), "w.line")
    return rows.select("first", fold(F.col("line")).alias("folded")).dropDuplicates(["first"]).withColumn("n", _n_words("folded"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of all rows, the text without its duplicate lines, and ``counts``: its lines before, and those removed.

    Rows with a null doc_id or text stay as they are (n_lines 0 for a null text), as do blank lines. Equal
    rows (doc_id and text) are one document and keep or lose the same lines; rows of one doc_id with
    different texts are documents of their own, in the order of a hash of the text. An empty table gives
    no rows. Columns named as ``counts`` are replaced; all others pass through, whatever their names.
    """
    # From a checkpoint, so that a doc_id that fills many rows can be split.
    removed = cut(removed_lines(docs.select("doc_id", "text"), min_words))
    inner = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(inner["text"])
    rows = docs.toDF(*inner.values()).withColumn("key", F.xxhash64(text))
    rows = rows.join(removed, (F.col(inner["doc_id"]) == F.col("doc_id")) & (F.col("key") == F.col("text_key")) & text.isNotNull(), "left")
    # The array of one element holds the split text as a variable, so that it is split once.
    shorter = F.transform(
        F.array(F.split(text, "\n")),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places")), lambda i: F.get(lines, i)), "\n"),
    )[0]
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lost = F.col("places").isNotNull()
    kept = {c: F.when(lost, shorter).otherwise(text) if c == "text" else F.col(at) for c, at in inner.items() if c not in counts}
    n_lines, n_removed = F.coalesce(breaks + 1, F.lit(0)).cast("long"), F.when(lost, F.size("places")).otherwise(0).cast("long")
    return rows.select(*kept.values(), n_lines, n_removed).toDF(*kept, *counts)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, place, trim(regexp_replace(lower(line), '[ \t\r\f]+', ' ', 'g'), ' ') AS folded
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
firsts AS (SELECT folded, min((doc_id, place)) AS first, string_split(folded, ' ') AS words, len(string_split(folded, ' ')) AS n
           FROM lines WHERE folded <> '' GROUP BY folded),
variants AS (
  SELECT first, -1 AS tag, folded AS variant, n AS length FROM firsts WHERE n >= {MIN_WORDS}
  UNION ALL
  SELECT first, i, array_to_string(list_concat(words[1:i], words[i + 2:]), ' '), n - 1
  FROM (SELECT *, unnest(range(n)) AS i FROM firsts WHERE n >= {MIN_WORDS})),
near AS (
  SELECT DISTINCT a.first FROM variants a JOIN variants b
    ON a.variant = b.variant AND a.length = b.length AND b.first < a.first AND (a.tag = b.tag OR a.tag = -1 OR b.tag = -1)),
gone AS (
  SELECT l.doc_id, l.place FROM lines l JOIN firsts f ON l.folded = f.folded LEFT JOIN near ON near.first = f.first
  WHERE near.first IS NOT NULL OR (l.doc_id, l.place) <> f.first),
kept AS (
  SELECT d.doc_id, d.place, d.line, g.place IS NOT NULL AS lost
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.place = d.place),
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '') AS text FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, md5(text) AS kept_md5 FROM texts
"""
