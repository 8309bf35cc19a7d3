"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.llm import bpe, decontaminate, html_mincut, line_dedup, ordinal, quality_rules, sentence_spans, simhash, suffix_dedup, token_pack
from thicket.llm.common import tuned

#: Where the vocabularies lie: a parameter of every operator that needs one.
try:
    import public_tokenizers

    VOCABULARY, PATTERN = public_tokenizers.path, public_tokenizers.PATTERN
except ImportError:  # the files may also lie in a plain folder
    VOCABULARY, PATTERN = "/opt/tokenizers/{}".format, r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = VOCABULARY("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, ranks, PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(*ordinal.labelled(docs, table(spark, sf_dir, "labels")))
    return ordinal.grades(docs, model, keep_text=False)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sentence_spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_sentences", "n_removed", "text")


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_pack.pack_table(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY("word_bpe_49k.json"), end_id=2, special_tokens=True)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.overlaps(docs, benchmark)


def op10_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_token_pack": op7_token_pack,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_mincut": op10_html_mincut,
}

def _op9_sql() -> str:
    """The seeds' hits, and each hit's best window, from the words themselves."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

    def places(source: str) -> str:
        masks = (" || ' ' || ".join(f"w[i + {o + 1}]" for o, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS)
        return " UNION ALL ".join(f"SELECT id, i, {n} AS mask, {key} AS k FROM (SELECT id, w, unnest(range(0, len(w) - {decontaminate.SPAN - 1})) AS i FROM {source} WHERE len(w) >= {decontaminate.SPAN})" for n, key in enumerate(masks))

    def whole(source: str, condition: str) -> str:
        return f"SELECT id, i, -n AS mask, array_to_string(w[i + 1 : i + n], ' ') AS k FROM (SELECT id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM {source}, (SELECT unnest(range({decontaminate.LEAST}, {decontaminate.SPAN})) AS n) WHERE {condition})"

    return f"""
WITH docs AS (SELECT doc_id AS id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT item_id AS id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
seeds AS ({places("items")} UNION ALL {whole("items", "len(w) = n")}),
places AS ({places("docs")} UNION ALL {whole("docs", "n IN (SELECT len(w) FROM items) AND len(w) >= n")}),
hits AS (SELECT DISTINCT p.id AS doc_id, s.id AS item_id, p.i - s.i AS shift FROM places p JOIN seeds s USING (mask, k)),
laid AS (SELECT doc_id, item_id, least({decontaminate.WINDOW}, len(i.w)) AS n_window, [CASE WHEN i.w[p + 1] = d.w[p + shift + 1] THEN 1 ELSE 0 END FOR p IN range(greatest(0, -shift), least(len(i.w), len(d.w) - shift))] AS same
  FROM hits JOIN docs d ON d.id = doc_id JOIN items i ON i.id = item_id),
best AS (SELECT doc_id, item_id, n_window, list_max([list_sum(same[i : i + n_window - 1]) FOR i IN range(1, len(same) - n_window + 2)]) AS n_matched FROM laid)
SELECT doc_id, item_id, CAST(max(n_matched) AS INTEGER) AS n_matched, CAST(max(n_window) AS INTEGER) AS n_window, max(n_matched) / max(n_window)::DOUBLE AS similarity FROM best
WHERE n_matched >= CASE WHEN n_window < {decontaminate.SPAN} THEN n_window ELSE ceil({decontaminate.SIMILARITY} * n_window) END GROUP BY doc_id, item_id"""


ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id < f.last AS gone FROM keyed LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
starts AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
bytes AS (SELECT doc_id, unnest(range(0, n)) AS i FROM d),
marked AS (SELECT b.doc_id, b.i, max(s.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM bytes b LEFT JOIN starts s ON b.doc_id = s.doc_id AND b.i = s.i),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked),
cut AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(substr(d.h, 2 * i + 1, 2), '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op9_decontaminate": _op9_sql(),
}
