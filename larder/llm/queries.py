"""The queries over this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op1_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5))
    model = train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.chat import joined, render, stale_replies

    found = render(stale_replies(table(spark, sf_dir, "conversations")))
    mask = {s: F.array_join(F.transform(s, lambda x: F.when(x["trained"], "1").otherwise("0")), "") for s in ("chosen", "rejected")}
    return found.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", *(joined(F.col(s)).alias(s) for s in mask), *(mask[s].alias(f"{s}_mask") for s in mask))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.chosen_path import similarity_join

    return similarity_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.html_wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), byte_bpe(), window=2048, end_id=1)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.substring import drop_repeats

    found = drop_repeats(table(spark, sf_dir, "documents"), least=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.multi_index import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.katz import score_texts

    fold = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(7))
    return score_texts(table(spark, sf_dir, "documents"), fold != 2)


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.tiling import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage")


QUERIES = {
    f.__name__: f
    for f in (op1_toxic_spans, op2_preference_pairs, op3_chosen_path_join, op4_license_scan, op5_wrapper_induction, op6_best_fit_packing, op7_repeated_passages, op8_inverted_multi_index, op9_katz_backoff, op10_string_tiling)
}


def license_sql(threshold: float = 0.8) -> str:
    from larder.llm.licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    words = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""
        WITH given(license, text) AS (VALUES {rows}),
        templates AS (SELECT license, len(words) AS length, list_distinct({pairs}) AS own FROM (SELECT license, {words.format("text")} AS words FROM given)),
        docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        cut AS (SELECT row, doc_id, list_transform(lines, lambda x: {words.format("x")}) AS lines FROM docs),
        flat AS (SELECT row, doc_id, flatten(lines) AS words, flatten(list_transform(lines, lambda x, i: list_transform(x, lambda w: i))) AS line_of FROM cut),
        texts AS (SELECT *, {pairs} AS grams FROM flat WHERE len(words) > 1),
        placed AS (SELECT row, unnest(line_of) AS line, unnest(range(1, len(words) + 1)) AS i FROM texts),
        units AS (
            SELECT row, min(i) AS first, max(i) AS last FROM placed GROUP BY row, line HAVING count(*) > 1
            UNION SELECT row, 1, max(i) FROM placed GROUP BY row HAVING count(DISTINCT line) > 1),
        unit_pieces AS (SELECT row, license, first, last FROM units JOIN texts USING (row), templates
            WHERE len(list_distinct(grams[first : last - 1])) BETWEEN len(own) * {threshold} / (2 - {threshold}) AND len(own) * (2 - {threshold}) / {threshold}),
        hits AS (SELECT row, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i, len(words) AS n FROM texts),
        starts AS (SELECT license, length, unnest(own) AS gram FROM templates),
        pieces AS (
            SELECT row, license, first, last FROM unit_pieces
            UNION SELECT row, license, i, least(i + length - 1, n) FROM hits JOIN starts USING (gram)),
        sized AS (SELECT p.*, doc_id, line_of, own, list_distinct(grams[first : last - 1]) AS here FROM pieces p JOIN texts USING (row) JOIN templates USING (license)),
        met AS (SELECT *, 2.0::DOUBLE * len(list_intersect(here, own)) / (len(here) + len(own)) AS dice FROM sized),
        found AS (SELECT *, max(last) OVER (PARTITION BY row, license ORDER BY first, last, dice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM met WHERE dice >= {threshold}),
        islands AS (SELECT *, sum(CASE WHEN before IS NULL OR first > before THEN 1 ELSE 0 END) OVER (PARTITION BY row, license ORDER BY first, last, dice DESC ROWS UNBOUNDED PRECEDING) AS island FROM found),
        best AS (SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY row, license, island ORDER BY dice DESC, first, last) = 1),
        ranked AS (SELECT *, len(list_intersect(here, own)) AS shared FROM best),
        met_in AS (SELECT o.row, CASE WHEN (o.shared, o.dice) > (i.shared, i.dice) OR (o.shared, o.dice) = (i.shared, i.dice) AND o.license < i.license
                                 THEN (i.license, i.island) ELSE (o.license, o.island) END AS loser
            FROM ranked o JOIN ranked i ON o.row = i.row AND (i.first - 1 + i.last - 1) // 2 BETWEEN o.first - 1 AND o.last - 1 AND i.last - i.first <= o.last - o.first AND o.license <> i.license)
        SELECT doc_id, CAST(line_of[first] AS INTEGER) AS line, CAST(line_of[last] AS INTEGER) AS last_line, license, dice, CAST(len(here) AS INTEGER) AS bigrams
        FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM met_in m WHERE m.row = r.row AND m.loser = (r.license, r.island))
    """


PREFERENCE_SQL = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM c),
    last AS (SELECT conv_id, max(p) AS last FROM ordered WHERE role = 'assistant' GROUP BY conv_id),
    stale AS (SELECT o.conv_id, max_by(text, p) AS stale FROM ordered o JOIN last l ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND p < last WHERE role = 'assistant' GROUP BY o.conv_id),
    sides AS (
        SELECT o.conv_id, p, last, role, text AS chosen, CASE WHEN p = last THEN coalesce(stale, '') ELSE text END AS rejected
        FROM ordered o JOIN last l ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND p <= last LEFT JOIN stale s ON s.conv_id IS NOT DISTINCT FROM o.conv_id),
    prefix AS (SELECT conv_id, coalesce(min(p) FILTER (WHERE chosen <> rejected), max(last) + 1) AS first FROM sides GROUP BY conv_id),
    turns AS (
        SELECT s.conv_id, p, first, '<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10) AS head,
               replace(replace(chosen, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS chosen,
               replace(replace(rejected, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10) AS rejected,
               CASE WHEN role = 'assistant' THEN '01' ELSE '00' END AS mask
        FROM sides s JOIN prefix x ON s.conv_id IS NOT DISTINCT FROM x.conv_id)
    SELECT conv_id, CAST(max(first) - 1 AS INTEGER) AS prompt_turns,
           coalesce(string_agg(head || chosen, '' ORDER BY p) FILTER (WHERE p < first), '') AS prompt,
           coalesce(string_agg(head || chosen, '' ORDER BY p) FILTER (WHERE p >= first), '') AS chosen,
           coalesce(string_agg(head || rejected, '' ORDER BY p) FILTER (WHERE p >= first), '') AS rejected,
           coalesce(string_agg(mask, '' ORDER BY p) FILTER (WHERE p >= first), '') AS chosen_mask,
           coalesce(string_agg(mask, '' ORDER BY p) FILTER (WHERE p >= first), '') AS rejected_mask
    FROM turns GROUP BY conv_id
"""

SQL = {
    "op2_preference_pairs": PREFERENCE_SQL,
    "op4_license_scan": license_sql(),
    "op7_repeated_passages": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS w FROM texts, unnest(range(1, len(words) - 48)) AS t(i)),
        first AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
        gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN first USING (w), unnest(range(i, i + 50)) AS t(p) WHERE low < doc_id),
        each AS (SELECT doc_id, words[p] AS word, p FROM texts, unnest(range(1, len(words) + 1)) AS t(p)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS joined FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(joined, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)
    """,
}
