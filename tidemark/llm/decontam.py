"""Benchmark decontamination by spaced seeds (operator 9), in DataFrame operations only.

A fixed mask keeps some of the words of a window and ignores the others, so a window still hits
where an ignored word was substituted. All windows of the benchmark items are hashed under every
mask; a document's windows are hashed alike, and where a hash is one of the benchmark's, the two
are laid on each other at that offset and compared word by word: the document holds the item if
some stretch of ``stretch`` words (the whole item if shorter) agrees in ``share`` of its words.

Items of fewer words than a mask spans can have no window: they count where they stand whole, found
by a hash of all their words. Items of fewer than ``least_words`` words name nothing and are not
looked for (1 looks for all).

How much the masks find, of all substitution patterns that the comparison accepts in one stretch: of
16 words with 3 substituted 97.5 %, of 15 with 3 92.7 %, of 12 with 2 85 %, of 10 with 2 27 % (with 1
80 %). Longer items have more windows and are all but never missed. Every hit is compared.

The benchmark's windows are broadcast only if there are ``most_hashes`` at most; then no document
is shuffled to find hits. A larger benchmark is joined by a shuffle of hashes. Only documents
with a hit, and only places with one, are compared word by word.

Defined results: words are lower-cased runs of letters, digits and characters beyond ASCII; null
texts count as empty; texts and items of any length are read whole; an empty item is in no text; items
that share an id are compared each on their own; of several places of an item in a document the one with most agreeing words counts, the
earliest among ties; an item without an id counts like any other, under a null item_id (the SQL
leaves such items out); repeated rows of one id count as one document that holds what any row holds;
other input columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staging
from tidemark.llm.licenses import SEPARATORS

#: Fixed masks: offsets of the words that are kept, all within SPAN.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 5, 6, 8, 9))
SPAN = 10
STRETCH = 16
SHARE = 0.8
MOST_HASHES = 200_000
LEAST_WORDS = 3


def words_of(text: Column) -> Column:
    """Lower-cased words as an array."""
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, " "))
    return F.when(norm == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(norm, " "))


def _seed(mask: int, at: str = "i", hashes: str = "h") -> str:
    """SQL of the hash of the window at ``at`` under a mask."""
    return f"xxhash64({mask}, " + ", ".join(f"{hashes}[{at} + {p}]" for p in MASKS[mask]) + ")"


def _whole(length: int, at: str = "i", hashes: str = "h") -> str:
    """SQL of the hash of ``length`` words in a row, for items that have no more."""
    return f"xxhash64('whole', {length}, " + ", ".join(f"{hashes}[{at} + {p}]" for p in range(length)) + ")"


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, item_key (hash of the words), item_words: every item that can be looked for."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
    items = items.where(F.size("item_words") >= max(1, least_words))
    return items.select("item_id", F.xxhash64("item_words").alias("item_key"), "item_words").distinct()


def benchmark_index(items: DataFrame) -> DataFrame:
    """seed, item_id, item_key, at: every window of every item under every mask; of items that are
    too short for one, the whole."""
    hashed = items.withColumn("h", F.transform("item_words", lambda w: F.xxhash64(w)))
    long_, short = hashed.where(F.size("h") >= SPAN), hashed.where(F.size("h") < SPAN)
    windows = long_.select("item_id", "item_key", "h", F.explode(F.sequence(F.lit(0), F.size("h") - SPAN)).alias("i"))
    seeds = F.array(*(F.expr(_seed(m)) for m in range(len(MASKS))))
    windows = windows.select(F.explode(seeds).alias("seed"), "item_id", "item_key", F.col("i").alias("at"))
    whole = None
    for n in range(1, SPAN):
        seed = F.when(F.size("h") == n, F.expr(_whole(n, "0")))
        whole = seed if whole is None else F.coalesce(whole, seed)
    return windows.unionByName(short.select(whole.alias("seed"), "item_id", "item_key", F.lit(0).alias("at"))).distinct()


def _verified(hits: DataFrame, stretch: int, share: float) -> DataFrame:
    """Of (id, key, words, item_id, item_words, offset): the hits whose words agree well enough."""
    n = F.size("item_words")
    lowest, beyond = F.greatest(F.lit(0), -F.col("offset")), F.least(n, F.size("words") - F.col("offset"))
    same = F.transform(F.sequence(lowest, beyond - 1), lambda j: F.when(F.get("words", j + F.col("offset")) == F.get("item_words", j), 1).otherwise(0))
    length = F.least(F.lit(stretch), n)
    hits = hits.withColumn("same", same).withColumn("length", length)
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    need = F.ceil(F.round(F.col("length") * F.lit(share), 6))
    enough = F.exists(F.sequence(F.lit(0), F.size("same") - F.col("length")), lambda s: total(F.slice("same", s + 1, F.col("length"))) >= need)
    enough = F.when(F.size("same") >= F.col("length"), enough).otherwise(F.lit(False))
    return hits.where(enough).select("id", "key", "item_id", total(F.col("same")).alias("matched"), F.size("same").alias("overlap"), (F.col("offset") + lowest).alias("start"))


def _laid(texts: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """(id, key, words, item_id, item_words, offset) of every hit. Only texts with a hit are split
    again; null ids meet too."""
    places = met.groupBy(F.col("id").alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_set(F.struct("item_id", "item_key", "offset")).alias("places"))
    found = texts.join(places, texts["key"].eqNullSafe(F.col("m_key")) & texts["id"].eqNullSafe(F.col("m_id")))
    found = found.select("id", "key", words_of(F.col("text")).alias("words"), "places").select("id", "key", "words", F.explode("places").alias("p"))
    found = found.select("id", "key", "words", F.col("p.item_id").alias("met_id"), F.col("p.item_key").alias("met_key"), "p.offset")
    return found.join(items, F.col("met_id").eqNullSafe(items["item_id"]) & (F.col("met_key") == items["item_key"])).drop("met_id", "met_key")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = STRETCH, share: float = SHARE, most_hashes: int = MOST_HASHES, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, key (hash of the text), item_id, matched, overlap and start of every place that counts."""
    staging = Staging(docs.sparkSession, "decontam")
    items = staging.keep(benchmark_items(benchmark, item_col, item_text_col, least_words), "items")
    index = staging.keep(benchmark_index(items), "index")
    lengths = sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # SPAN - 1 values at most
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).alias("text"))
    every = texts.select("id", "key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    hashed = every.where(F.size("h") >= SPAN)
    places = f"sequence(0, size(h) - {SPAN})"
    seeds = [f"transform({places}, i -> {_seed(m)})" for m in range(len(MASKS))]
    # all windows under the first mask, then all under the second
    windows = hashed.select("id", "key", F.expr(f"size(h) - {SPAN - 1}").alias("n"), F.posexplode(F.expr(f"concat({', '.join(seeds)})")).alias("i", "seed"))
    for length in lengths:
        whole = F.expr(f"transform(sequence(0, size(h) - {length}), i -> {_whole(length)})")
        windows = windows.unionByName(every.where(F.size("h") >= length).select("id", "key", F.expr(f"size(h) - {length - 1}").alias("n"), F.posexplode(whole).alias("i", "seed")))
    small = index.limit(most_hashes + 1).count() <= most_hashes
    posted = index.select("seed", "item_id", "item_key", "at")
    met = windows.join(F.broadcast(posted) if small else posted, "seed")
    met = met.select("id", "key", "item_id", "item_key", (F.pmod("i", "n") - F.col("at")).alias("offset")).distinct()
    met = staging.keep(met, "met")
    hits = _laid(texts, met, items)
    return _verified(hits, stretch, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = STRETCH, share: float = SHARE, most_hashes: int = MOST_HASHES, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each document and item it holds: id_col, item_id, matched (int, agreeing
    words), overlap (int, words laid on each other), start (int, first such word of the document).
    """
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "overlap")).alias("best")
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, stretch, share, most_hashes, least_words).groupBy("id", "item_id").agg(best)
    return found.select(F.col("id").alias(id_col), "item_id", "best.matched", "best.overlap", (-F.col("best.start")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows are told apart by id
    and text, so one leaking row takes no other with it that has its id, or none either."""
    staging = Staging(docs.sparkSession, "decontaminated")
    found = _found(docs, benchmark, id_col, text_col, **options)
    bad = staging.keep(found.select(F.col("id").alias("_bad"), F.col("key").alias("_key")).distinct(), "bad")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_key"]), "left_anti")


def contaminated_sql(stretch: int = STRETCH, share: float = SHARE, least_words: int = LEAST_WORDS) -> str:
    """The op9 result in DuckDB SQL: windows are joined by their kept words."""
    words = lambda c: f"CASE WHEN trim(regexp_replace(lower(coalesce({c}, '')), '{SEPARATORS}', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(lower(coalesce({c}, '')), '{SEPARATORS}', ' ', 'g')), ' ') END"
    keyed = lambda m: "concat_ws(' ', " + f"'{m}', " + ", ".join(f"w[i + {p + 1}]" for p in MASKS[m]) + ")"
    windows = lambda t, k: " UNION ALL ".join(f"SELECT {k}, i, {keyed(m)} AS seed FROM {t}, range(0, len(w) - {SPAN - 1}) AS r(i)" for m in range(len(MASKS)))
    return f"""
    WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
    b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
    whole AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN {least_words} AND {SPAN - 1}),
    dw AS ({windows('d', 'doc_id')} UNION ALL
      SELECT doc_id, i, 'whole ' || array_to_string(w[i + 1 : i + n], ' ') FROM d, whole, range(0, len(w) - n + 1) AS r(i)),
    bw AS ({windows('b', 'item_id')} UNION ALL
      SELECT item_id, 0, 'whole ' || array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN {least_words} AND {SPAN - 1}),
    met AS (SELECT DISTINCT doc_id, item_id, dw.i - bw.i AS o FROM dw JOIN bw USING (seed)),
    laid AS (
      SELECT doc_id, item_id, o, len(b.w) AS n, greatest(0, -o) AS lowest, least(len(b.w), len(d.w) - o) AS beyond, d.w AS dw, b.w AS bw
      FROM met JOIN d USING (doc_id) JOIN b USING (item_id)),
    same AS (
      SELECT doc_id, item_id, o, lowest, beyond, least({stretch}, n) AS length,
             list_transform(range(lowest, beyond), lambda j: CASE WHEN dw[j + o + 1] = bw[j + 1] THEN 1 ELSE 0 END) AS s FROM laid),
    good AS (
      SELECT doc_id, item_id, list_sum(s) AS matched, beyond - lowest AS overlap, o + lowest AS start FROM same
      WHERE len(s) >= length
        AND len(list_filter(range(0, len(s) - length + 1), lambda a: list_sum(s[a + 1 : a + length]) >= ceil(round(length * {share}, 6)))) > 0)
    SELECT doc_id, item_id, matched::INTEGER AS matched, overlap::INTEGER AS overlap, start::INTEGER AS start FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start, overlap DESC) AS rn FROM good)
    WHERE rn = 1
    """
