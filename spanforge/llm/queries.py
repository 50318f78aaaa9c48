"""The queries of this subpackage; each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import encode_digests
from .covertree import embedding_links
from .lexical import search
from .linededup import line_digests
from .negatives import mine_negatives, quantised
from .ordermin import fingerprint_edits
from .packing import pack_documents
from .passages import find_passages, remove_passages
from .simhash import similar_components, simhash_components
from .store import fresh_path
from .suffixes import remove_repeats
from .tokencount import count_tokens
from .toxicity import learn, reject_toxic, score_documents
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]

#: Rows and bytes sent to a Python worker at once: texts are long, so the library's default of 10 000 rows would need hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def set_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    set_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that are near copies of one with a smaller doc_id: one of each group stays.

    Near copies are texts whose sets of five-word shingles have a Jaccard index
    of 0.8 or more, directly or through others. Texts without words (null, empty, white space) are one
    group; very long texts are compared whole. Of rows with equal doc_id and text one stays; rows of one doc_id with different texts are judged by
    the id, and rows without an id always stay. Other columns, of whatever names, are kept as they are; an empty table stays empty.
    """
    set_batches(spark)
    others = similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


def toxic_rejects(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that score as toxic; rows and columns stay as they are.

    Null, empty and very long texts are scored like any other, whole; repeated
    rows and rows without id stay or go by their text alone; columns may have any names; an empty
    table stays empty. Labels of held-out rows are not learnt from.
    """
    set_batches(spark)
    return reject_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"))


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the passages that a document of smaller id has too (see :func:`remove_passages`).

    All rows and columns stay, whatever the columns' names; texts without such
    passages are unchanged, null and empty ones included. Repeated rows of a doc_id are cut alike; rows without id are
    unchanged; an empty table stays empty.
    """
    set_batches(spark)
    return remove_passages(docs)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(quantised(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_order_minhash": op6_order_minhash,
    "op7_cover_tree": op7_cover_tree,
    "op8_passages": op8_passages,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_arrays": op10_suffix_arrays,
    "op11_lexical_search": op11_lexical_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": """
        with p as (
            select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
        ), g as (
            select page_id, strlen(html) as payload_bytes, sha,
                   max(page_id) over (partition by html) as holder
            from p
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
               translate(
                   lpad(to_base(('0x' || substr(sha, 1, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 6, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 11, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 16, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 21, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 26, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 31, 5))::bigint, 32), 4, '0')
                   || lpad(to_base(('0x' || substr(sha, 36, 5))::bigint, 32), 4, '0'),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
               case when page_id = holder then 'response' else 'revisit' end as record_type,
               case when page_id <> holder then holder end as refers_to
        from g
    """,
    "op7_cover_tree": """
        with recursive v as (
            select vec_id, label, cast(embedding as double[]) as e from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(u, w) as (
            select vec_id, vec_id from embeddings
            union
            select r.u, l.w from reach r join links l on l.u = r.w
        ), n as (
            select u, count(*) as n_links from links group by u
        ), c as (
            select u, min(w) as component_id from reach group by u
        )
        select c.u as vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, c.u = c.component_id as kept
        from c left join n on n.u = c.u
    """,
    "op11_lexical_search": """
        with d as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from documents
        ), q as (
            select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark
        ), n as (
            select doc_id, count(*) as n from d group by all
        ), z as (
            select count(*) as docs, cast(sum(n) as bigint) as l from n
        ), tf as (
            select doc_id, t, count(*) as tf from d where t in (select t from q) group by all
        ), w as (
            select t, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, z group by t, docs
        ), s as (
            select q.item_id, tf.doc_id, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + ((25 * n.n * z.docs) // z.l))))) as bigint) as score
            from q join w on w.t = q.t join tf on tf.t = q.t join n on n.doc_id = tf.doc_id, z group by all
        )
        select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
        from s where score > 0 qualify rank <= 20
    """,
    "op12_line_dedup": """
        with k as (
            select doc_id, string_split(coalesce(text, ''), chr(10)) as lines,
                   list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as keys from documents
        ), often as (
            select key from (select distinct doc_id, unnest(keys) as key from k) where length(key) >= 1 group by key having count(*) >= 10
        ), l as (
            select doc_id, unnest(lines) as line, unnest(keys) as key, unnest(range(len(lines))) as place from k
        )
        select doc_id, count(*) as n_lines, count(o.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by place) filter (o.key is null), '')) as kept_sha256
        from l left join often o on o.key = l.key group by doc_id
    """,
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as a, b.vec_id as b, a.label = b.label as alike, cast(list_dot_product(a.e, b.e) as bigint) as score
            from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
        ), p as (
            select a, b, score from s where alike qualify row_number() over (partition by a order by score desc, b) <= 5
        )
        select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank,
               s.b as negative_id, p.score as positive_score, s.score as negative_score
        from p join s on s.a = p.a and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
        qualify rank <= 10
    """,
}
