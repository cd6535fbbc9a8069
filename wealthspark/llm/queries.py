"""The registered queries of the training-data operators, over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact_dedup, html_extract, lm_score, merkle, near_dedup, packing, quality, search, secret_scan, substring_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.main_text(spark, pages, html_extract.trained(spark), keep=("url",))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, on two-word shingles."""
    return near_dedup.near_duplicates(spark, documents(spark, sf_dir), k=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(spark, documents(spark, sf_dir), vocabulary_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels of held-out rows are never read by the model."""
    docs = documents(spark, sf_dir)
    learned = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out("doc_id"))
    model = quality.train(docs, learned)
    out = quality.score(spark, docs, model)
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that a smaller document has."""
    out = substring_dedup.remove_repeats(spark, documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: the written forms as a digest, and all spans."""
    found = secret_scan.scan(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.written_spans(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.written_spans(F.col("spans")).alias("spans"), count("entropy"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, by chunk recipes."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    out = bpe.encode_decode(spark, documents(spark, sf_dir), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, by its whole text."""
    docs = documents(spark, sf_dir)
    found = search.search(spark, docs, docs.filter(F.col("doc_id") % 100 == 0))
    return found.withColumn("score", F.round("score", 4))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = lm_score.score(spark, documents(spark, sf_dir), F.coalesce(~held, F.lit(True)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language, over all documents."""
    return collocations.phrases(spark, documents(spark, sf_dir))


#: The fields of a leaf, in their order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents; where 3 divides the id's checksum the text is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle.manifest(spark, documents(spark, sf_dir), LEAF, "lang", tampered=tampered, proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: A conversation whose texts hold the control strings of common templates.
STRANGE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the strange one, formatted and read back from the output."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = given.union(spark.createDataFrame(STRANGE, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_turns(spark, turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_near_dedup": op2_near_dedup,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secrets": op6_secrets,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_search": op9_search,
    "op10_lm_score": op10_lm_score,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_chat": op13_chat,
}

#: Words of a text: what stands between the six ASCII white-space characters.
WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"



def merkle_sql(levels: int = 7, over: int = 3) -> str:
    """Trees of at most 8 ** levels documents a language and 8 ** over languages."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    whole, changed = (f"sha256({' || '.join(field(c) for c in (*LEAF[:-1], text))})" for text in ("text", lowered))
    bits = "b0 AS (SELECT range AS n, range AS v FROM range(256))"
    for k in range(8):
        bits += f", b{k + 1} AS (SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b{k})"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295), 4294967295)"
    out = [
        f"{bits}, crc AS (SELECT list(v ORDER BY n) AS t FROM b8)",
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {whole} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} ELSE {whole} END AS bad FROM documents, crc)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, leaf AS h FROM d)",
        "p0 AS (SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, '' AS proof, bad AS f FROM d)",
    ]

    def climb(nodes: str, proofs: str, number: int) -> None:
        for k in range(number):
            node = "CASE WHEN m = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END"
            out.append(f"r{nodes}{k} AS (SELECT g, i // 8 AS i, list(h ORDER BY i) AS hs, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {nodes}{k}) GROUP BY g, i // 8)")
            out.append(f"{nodes}{k + 1} AS (SELECT g, i, {node} AS h FROM r{nodes}{k})")
            left, right = "array_to_string(hs[1:p.i % 8], '')", "array_to_string(hs[p.i % 8 + 2:], '')"
            out.append(
                f"{proofs}{k + 1} AS (SELECT p.* REPLACE (p.i // 8 AS i, CASE WHEN m = 1 THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN m = 1 THEN f ELSE sha256({left} || f || {right}) END AS f) "
                f"FROM {proofs}{k} p JOIN r{nodes}{k} r ON p.g = r.g AND p.i // 8 = r.i)"
            )

    climb("n", "p", levels)
    out.append(f"m0 AS (SELECT 'top' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS of FROM n{levels})")
    out.append(f"q0 AS (SELECT p.doc_id, p.leaf, m.h AS subroot, 'top' AS g, m.i, p.proof, p.f FROM p{levels} p JOIN m0 m ON p.g = m.of)")
    climb("m", "q", over)
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{over}, m{over}"


ORACLE_SQL: dict[str, str] = {
    "op11_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda v: v <> '') AS w FROM d),
g AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
x AS (SELECT lang, row_number() OVER () AS piece, w FROM w),
t AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM x),
u AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS (SELECT lang, [w1] AS p, count(*) AS a FROM u GROUP BY lang, w1 HAVING count(*) >= 30
      UNION ALL SELECT lang, [w1, w2], count(*) FROM u WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
      UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM u WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
      UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM u WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
h AS (SELECT f.*, k, p[1:k] AS x, p[k + 1:] AS y FROM f JOIN range(1, 4) q(k) ON k < len(p)),
c AS (SELECT h.lang, h.p, h.a, x.a AS l, y.a AS r, k, CAST((2000000 * CAST(h.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
      FROM h JOIN f x ON x.lang = h.lang AND x.p = h.x JOIN f y ON y.lang = h.lang AND y.p = h.y),
b AS (SELECT lang, p, any_value(a) AS a, arg_min(l, score * 4 + k) AS l, arg_min(r, score * 4 + k) AS r, min(score) AS score FROM c GROUP BY lang, p),
o AS (SELECT lang, p[1:len(p) - 1] AS p, a FROM f WHERE len(p) > 2 UNION ALL SELECT lang, p[2:], a FROM f WHERE len(p) > 2
      UNION ALL SELECT lang, unnest([p[1:2], p[2:3], p[3:4]]), a FROM f WHERE len(p) = 4),
m AS (SELECT lang, p, max(a) AS longer FROM o GROUP BY lang, p),
z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase, a, l, r, score
      FROM b LEFT JOIN m ON m.lang = b.lang AND m.p = b.p WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT z.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z JOIN g ON z.lang = g.lang WHERE rank <= 2000""",
    "op12_merkle": merkle_sql(),
    "op13_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(role) + length(text) + len(regexp_extract_all(role, '\\|###|</turn>|: ')) + len(regexp_extract_all(text, '\\|###|</turn>')) + 14) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op2_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.x""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM i),
m AS (SELECT t, min(doc_id) AS least FROM x GROUP BY t),
b AS (SELECT x.doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN m ON x.t = m.t WHERE least < x.doc_id),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM b GROUP BY doc_id),
k AS (SELECT w.doc_id, w, list_filter(w, lambda v, n: gone IS NULL OR NOT list_contains(gone, n)) AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op9_search": f"""
WITH w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
g AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM w),
f AS (SELECT doc_id, t, any_value(dl) AS dl, count(*) AS tf FROM t GROUP BY doc_id, t), d AS (SELECT t, count(*) AS df FROM f GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (g.n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / mean))), 6) AS score
      FROM f q JOIN f p ON q.t = p.t JOIN d ON d.t = q.t, g WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10""",
}
