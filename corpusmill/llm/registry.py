"""Queries of the llm operators over whole tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    collision_ann,
    debruijn_dedup,
    fp_search,
    imatch,
    line_dedup,
    mixing,
    ngram_join,
    quality_crf,
    secret_scan,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    suffix_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards whose counts differ by one at most, equal texts together."""
    placed = sharding.balanced_shards(_table(spark, sf_dir, "documents"), num_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets by pattern, and all spans with those the randomness tests add."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set of 3-word shingles by size, and its component of sets with Jaccard similarity 0.9 or more."""
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings")
    return collision_ann.nearest_neighbours(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and place when sources are mixed by square-root weights."""
    return mixing.schedule(_table(spark, sf_dir, "documents")).drop("__row")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings that a document with a smaller id holds."""
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of recurring templates."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, dropped_col="n_dropped")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's I-Match fingerprint against those of its edited text and of the next document."""
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; only rows outside the held-out fifth teach labels."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5))
    model = quality_crf.fit(docs, labels, usable=fold("__id") != 0)
    scored = quality_crf.score(docs, model)
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether decoding them gives the text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    return coded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its form, the last of its forms and its number of neighbours, some occurrences being misspelt."""
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"), edit_every=199)


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without sequences of 13 words that a document with a smaller id holds."""
    return debruijn_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op13_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for each benchmark item."""
    return fp_search.rank_documents(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_collision_ann": op4_collision_ann,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_imatch": op8_imatch,
    "op9_quality_crf": op9_quality_crf,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_debruijn_dedup": op12_debruijn_dedup,
    "op13_fp_search": op13_fp_search,
}
# all pairs that share a shingle, and reachability over the links; the other operators have no SQL form or one that is
# too slow on whole tables, and are tested against brute force
ORACLES: dict[str, str] = {
    # bytes as pairs of hexadecimal digits, cut from blocks of 1000 bytes; removed runs are islands of covered starts
    "op6_suffix_dedup": r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    b AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 2098) AS h FROM (SELECT *, unnest(range(0, n, 1000)) AS b FROM d)),
    s AS (SELECT doc_id, b + i AS place, md5_number(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT *, unnest(range(0, least(1000, n - 49 - b))) AS i FROM b)),
    m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)), c AS (SELECT doc_id, place FROM s JOIN m USING (g) WHERE doc_id > least),
    e AS (SELECT *, CAST(coalesce(place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50, true) AS INT) AS new FROM c),
    r AS (SELECT doc_id, min(place) AS a, max(place) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM e) GROUP BY doc_id, run),
    k AS (SELECT r.doc_id, r.a, r.z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS before FROM r JOIN d USING (doc_id)),
    t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(before, '' ORDER BY a) AS head, max(z) AS z FROM k GROUP BY doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * z + 1), h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op12_debruijn_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING count(*) > 1), c AS (SELECT doc_id, i FROM s JOIN m USING (g) WHERE doc_id > least),
    p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    k AS (SELECT p.doc_id, p.i, word, max(c.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN c USING (doc_id, i)),
    a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op13_fp_search": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
    m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM l, a),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    # the CRC-32 table comes from its polynomial; letters lie below U+0100, so their UTF-8 bytes are one or two expressions
    "op11_spelling_variants": r"""WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
      SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    bytes AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: unicode(c)) AS u FROM held),
    hashed AS (SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(u, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END)),
      lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INT) + 1], c // 256)), 4294967295) AS h FROM bytes, crc),
    edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y USING (i, cut) WHERE x.word <> y.word
      UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.cut UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.cut),
    best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM near JOIN words ON word = b),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 5 * w.n THEN x.b END AS form, CASE WHEN x.n >= 5 * w.n THEN x.n END AS form_n
      FROM words w LEFT JOIN best x ON x.a = w.word AND rn = 1),
    walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.next)
    SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word WHERE k.next IS NULL""",
    "op3_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b)
    SELECT d AS doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
}
