"""The opN_ queries: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import ball_kmeans, html_text, language, media, minhash, mixing, packing, quality, quality_rules, resampling, substring, suffix_sort, token_output
from mnemospark.llm.common import shared_path, tokenizer_path

END_ID = 2
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), copies_once=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_chars"
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_output.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(TOKENIZER), end_id=END_ID)
    return token_output.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs.where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return language.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = media.text_media(table(spark, sf_dir, "documents"))
    return media.tile_digests(tiles, keep=["doc_id", "n_bytes"])


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_sort.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # a row a cluster
    known = [(i, sums.get(i, 0), sum(sums.values()), ball_kmeans.centroid_digest(c)) for i, c in enumerate(found.centroids)]
    clusters = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_quality_classifier, op3_quality_rules, op4_token_output, op5_html_extraction, op6_packing, op7_language_id, op8_substring_dedup, op9_minhash_dedup, op10_media_columns, op11_resampling, op12_suffix_dedup, op13_ball_kmeans)
}

WORD_LIST = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def kmeans_sql(rounds: int, k: int) -> str:
    """k-means round by round: every vector against every centroid."""
    near = "select vec_id, v, arg_min(c.cluster, d) as cluster, min(d)[1] as distance from (select vec_id, v, c.cluster, [list_sum(list_transform(range(1, 65), lambda j: (v[j] - c.c[j]) * (v[j] - c.c[j])))::bigint, c.cluster] as d from q, {c} c) c group by 1, 2"
    steps = [
        """q as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"c0 as (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v as c from q order by sha256('1:' || vec_id) limit {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} as ({near.format(c=f'c{i}')})")
        steps.append(f"s{i} as (select cluster, j, floor(sum(x) / count(*))::bigint as m, sum(x)::bigint as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as j from a{i}) group by 1, 2)")
        steps.append(f"m{i} as (select cluster, list(case when s % n < 0 then s // n - 1 else s // n end order by j) as c from s{i} group by 1)")
        steps.append(f"c{i + 1} as (select cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))")
    return f"""with {", ".join(steps)}, f as ({near.format(c=f"c{rounds}")})
select vec_id, cluster::int as cluster, distance::bigint as distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
 sha256(array_to_string(c.c, ',')) as centroid_sha256 from f join c{rounds} c using (cluster)"""


#: Oracles, for what SQL can express; the others are tested in tests/llm.
SQL: dict[str, str] = {
    "op3_quality_rules": rf"""with d as (select doc_id, source, coalesce(text, '') as t, {WORD_LIST} as w from documents),
raw as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from raw where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
win as (select doc_id, s, w[s:s+2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as s from d)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([s, s + 1, s + 2]) as p from win qualify count(*) over (partition by doc_id, g) > 1) group by 1),
norm as (select doc_id, source, t, unnest(string_split(regexp_replace(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', '', 'g'), '[1-9]', '0', 'g'), chr(10))) as line from d),
freq as (select source, lower(line) as l from norm where line <> '' group by 1, 2 having count(distinct t) > 50),
gone as (select doc_id, sum(length(line))::bigint as chars from norm join freq on lower(norm.line) = freq.l and norm.source is not distinct from freq.source group by 1),
f as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
 coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(chars, 0) as boilerplate_chars
 from d left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars - boilerplate_chars >= 0.3 * word_chars as kept from f""",
    "op8_substring_dedup": rf"""with d as (select doc_id, {WORD_LIST} as w from documents),
win as (select doc_id, s, md5(array_to_string(w[s:s+19], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as s from d)),
late as (select doc_id, s from win qualify row_number() over (partition by h order by doc_id, s) > 1),
gone as (select distinct doc_id, s + unnest(range(0, 20)) as p from late),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) as c from gone group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(c, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id) left join n using (doc_id)""",
    "op9_minhash_dedup": rf"""with recursive d as (select doc_id, list_transform({WORD_LIST}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as g from (select doc_id, w, unnest(range(1, case when len(w) = 1 then 2 else greatest(len(w), 1) end)) as i from d)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e2 as (select x, y from e union all select y, x from e),
r as (select doc_id, doc_id as root from d union select e2.y, r.root from r join e2 on e2.x = r.doc_id where r.root < e2.y)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(root) as component_id, doc_id = min(root) as kept from r left join n using (doc_id) group by doc_id, n.n""",
    "op12_suffix_dedup": r"""with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
win as (select doc_id, s, md5(b[s:s+99]) as h from (select doc_id, b, unnest(range(1, greatest(octet_length(b) - 98, 1))) as s from d)),
late as (select doc_id, s from win qualify row_number() over (partition by h order by doc_id, s) > 1),
run as (select doc_id, s, sum(case when s - p <= 100 then 0 else 1 end) over (partition by doc_id order by s) as g from (select doc_id, s, coalesce(lag(s) over (partition by doc_id order by s), -1000) as p from late)),
span as (select doc_id, min(s) as a, max(s) + 100 as z from run group by doc_id, g),
cut as (select doc_id, list_sort(list(a)) as a, list_sort(list(z)) as z from span group by 1),
edge as (select doc_id, b, octet_length(b) as n, coalesce(a, []::bigint[]) as a, coalesce(z, []::bigint[]) as z from d left join cut using (doc_id)),
part as (select doc_id, i, b[(case when i = 1 then 1 else z[i - 1] end):(case when i > len(a) then n else a[i] - 1 end)] as x, (case when i > len(a) then n else a[i] - 1 end) as q, (case when i = 1 then 1 else z[i - 1] end) as f
 from (select *, unnest(range(1, len(a) + 2)) as i from edge)),
kept as (select doc_id, unhex(string_agg(case when q < f then '' else hex(x) end, '' order by i)) as k from part group by 1)
select doc_id, n::bigint as n_bytes, coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: z[i] - a[i])), 0)::bigint as n_removed, len(a)::bigint as n_spans, sha256(k) as kept_sha256
from edge join kept using (doc_id)""",
    "op13_ball_kmeans": kmeans_sql(rounds=3, k=16),
}
