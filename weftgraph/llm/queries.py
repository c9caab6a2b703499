"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, documents, ready
from weftgraph.llm.conversations import conversation_repair, conversation_sql
from weftgraph.llm.exact_dedup import exact_dedup
from weftgraph.llm.licenses import license_scan, license_sql
from weftgraph.llm.minhash import minhash_components
from weftgraph.llm.mixing import mix_sources, mixing_sql
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.pii import pii_scan, pii_sql
from weftgraph.llm.quality import quality_rules, quality_sql
from weftgraph.llm.secrets import secret_scan, secret_sql
from weftgraph.llm.token_counts import token_counts
from weftgraph.llm.toxicity import toxicity
from weftgraph.llm.vector_codes import vector_codes, vector_sql
from weftgraph.llm.warc import warc_round_trip


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ready(spark), sf_dir)
    return f


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


@_query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)


ORACLE_SQL["op6_warc_revisits"] = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
s AS (SELECT page_id, p, sha1(p) AS hex FROM h),
t AS (SELECT page_id, strlen(p) AS payload_bytes, min(page_id) OVER (PARTITION BY p) AS first_,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_ THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_ THEN first_ END AS refers_to FROM t
"""


@_query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir), width=3, num=85, den=100)


ORACLE_SQL["op8_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
b AS (SELECT x AS src, y AS dst FROM l UNION ALL SELECT y, x FROM l),
cc(id, component) USING KEY (id) AS (SELECT src, min(least(src, dst)) FROM b GROUP BY src UNION
  SELECT b.dst, min(cc.component) FROM cc JOIN b ON b.src = cc.id JOIN recurring.cc o ON o.id = b.dst WHERE cc.component < o.component GROUP BY b.dst)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN cc ON cc.id = d.doc_id
"""


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@_query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Domains of the sources and integer weights by path of the mix.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"], "books": ["src8", "src9", "src10", "src11"], "forums": ["src12", "src13", "src14", "src15"]}
WEIGHTS: dict[tuple[str, ...], int] = {("web",): 40, ("books",): 35, ("forums",): 15, ("other",): 10}
WEIGHTS |= {(d, lang): w for d in ("web", "books", "forums", "other") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))}
WEIGHTS |= {("web", "en", "src0"): 3, ("books", "en", "src8"): 2, ("forums", "de", "src12"): 4}
MIX = {"max_epochs": 4, "numerator": 3, "denominator": 5, "seed": 7}


def domain_of():
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(sources), name).otherwise(out)
    return out


DOMAIN_SQL = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + " ELSE 'other' END"


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), WEIGHTS, domain_of(), **MIX)


ORACLE_SQL["op1_source_mixing"] = mixing_sql(WEIGHTS, DOMAIN_SQL, **MIX)


@_query
def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


ORACLE_SQL["op3_license_digests"] = license_sql()


@_query
def op5_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir), scope=200)


ORACLE_SQL["op5_secret_linking"] = secret_sql(200)


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL["op4_quality_rules"] = quality_sql()


@_query
def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(documents(spark, sf_dir))


ORACLE_SQL["op11_pii_spans"] = pii_sql()


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2, scale=256)


ORACLE_SQL["op12_vector_codes"] = vector_sql(parts=16, entries=64, rounds=2, scale=256)


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL["op13_conversation_repair"] = conversation_sql()
