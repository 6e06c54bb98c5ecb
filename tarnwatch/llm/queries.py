"""The registered queries of the training-data operators and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import bpe, changes, embed_dedup, html_extract, media, mixing, ngram_join, packing, pipeline, quality, sharding, spelling, toxicity, warc
from tarnwatch.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256",
        "feature", "width", "height",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.applied(table(spark, sf_dir, "client_changes"))


def queries() -> dict:
    own = (
        op1_toxicity, op2_quality, op3_warc, op4_embedding_dedup, op5_sharding, op6_media, op7_mixing, op8_ngram_join, op9_html_extract,
        op10_packing, op11_bpe, op12_spelling, op13_changes,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORDS = r"[^\x20\x09-\x0D]+"

OP3 = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as x from p),
e as (select *, max(page_id) over (partition by x) as top from d)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', cast((cast('0x' || substr(x, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> (15 - i % 4 * 5)) % 32 + 1 as bigint), 1)), '') as payload_digest,
  case when page_id is not distinct from top or top is null then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to
from e
"""

OP4 = """
with v as (select row_number() over () as r, vec_id, label, embedding from embeddings),
g as (select r, vec_id, label, cast(embedding as double[]) as x from v
  where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
l as (select a.r as s, b.r as t from g a join g b on a.label = b.label and len(a.x) = len(b.x) and a.r < b.r where list_cosine_similarity(a.x, b.x) >= 0.98),
e as (select s, t from l union all select t, s from l),
n as (select s, count(*) as n_links from e group by s),
reach as (with recursive w(s, t) as (select r, r from g union select w.s, e.t from w join e on w.t = e.s) select s, min(vec_id) as c from w join v on w.t = v.r group by s)
select v.vec_id, coalesce(n.n_links, 0) as n_links, coalesce(reach.c, v.vec_id) as component_id, coalesce(v.vec_id = coalesce(reach.c, v.vec_id), false) as kept
from v left join n on v.r = n.s left join reach on v.r = reach.s
"""

OP5 = """
with recursive d as (select doc_id, coalesce(octet_length(encode(text)), 0) as n, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h from documents),
s as (select k, h >> (60 - k) as p, sum(n) as b, min(h) = max(h) as one from d, range(61) t(k) group by all),
leaf as (select d.doc_id, d.n, d.h, min(s.k) as depth from d join s on s.p = d.h >> (60 - s.k) where s.b <= 1048576 or s.one group by all),
m as (select l.doc_id, l.n, l.depth, s.b, right(lpad(bin(s.p), 60, '0'), cast(l.depth as int)) as bits from leaf l join s on s.k = l.depth and s.p = l.h >> (60 - l.depth)),
o as (select *, case when b <= 1048576 then '' else '+' || n || '.' || ((row_number() over (partition by bits, n, depth order by doc_id) - 1) // greatest(1, 1048576 // greatest(n, 1))) end as page from m)
select o.doc_id, cast(o.n as bigint) as n_bytes, cast(o.depth as int) as depth, case when depth = 0 then '' else bits end || page as shard,
  cast(case when page = '' then b else sum(n) over (partition by bits, page) end as bigint) as shard_bytes
from o
"""

OP7 = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as size,
    coalesce(len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')), 0) as marks,
    (cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u from documents),
k as (select *, -ln(u) / greatest(case when size > 0 then cast(size as double) / cast(size + marks as double) else 1.0 end, 1e-6) as key from d),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as w, 3 * source_size as cap from s),
o as (select *, sum(source_size) over () as total, coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as done,
    sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as lft from w),
c as (select *, cap / w <= cast(total - done as double) / cast(lft as double) as capped from o),
f as (select *, coalesce(sum(case when capped then cap end) over (), 0) as spent, sum(case when not capped then w end) over () as opn from c),
t as (select source, source_size, case when capped then cast(cap as double) else cast((total - spent) * w as double) / cast(opn as double) end as target from f),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
r as (select k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size as budget,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and current row) as upto
  from k join b on k.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (epochs + case when size > 0 and (upto <= budget or (upto - size < budget and upto - budget < budget - (upto - size))) then 1 else 0 end) as bigint) as taken
from r
"""

OP8 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
s as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d),
u as (select r, doc_id, len(g) as n, unnest(g) as t from s),
i as (select a.r as x, b.r as y, count(*) as k from u a join u b on a.t = b.t and a.r < b.r group by all),
p as (select a.doc_id as x, b.doc_id as y from i join s a on i.x = a.r join s b on i.y = b.r where 100 * k >= 80 * (len(a.g) + len(b.g) - k) and a.doc_id <> b.doc_id),
e as (select x, y from p union select y, x from p),
reach as (with recursive w(x, y) as (select x, x from e union select w.x, e.y from w join e on w.y = e.x) select x, min(y) as c from w group by x)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, coalesce(reach.c, s.doc_id) as component_id from s left join reach on s.doc_id = reach.x
"""


def oracle_sql() -> dict:
    """op1, op2, op6, op9, op10 and the pipeline are tested against brute force, round trips and held-out rows."""
    return {"op3_warc": OP3, "op4_embedding_dedup": OP4, "op5_sharding": OP5, "op7_mixing": OP7, "op8_ngram_join": OP8}
