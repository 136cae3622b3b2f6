"""Registered queries of the subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    bpe, decontaminate, lines, merkle, outliers, ppm, quality, simhash, substrings, tokenfile, vectors, webpages,
    whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_bpe_round_trip(spark, sf_dir):
    coded = bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(text, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from benchmark),
grams as (select distinct item_id, ws[i : i + least(len(ws), 13) - 1] gram, least(len(ws), 13) n
    from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) i
          from b where len(ws) > 0)),
spans as (select doc_id, i, n, ws[i : i + n - 1] gram from (
    select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) i
    from d, (select distinct n from grams) where len(ws) >= n)),
hits as (select doc_id, i, grams.n, item_id from spans join grams using (gram)),
pos as (select doc_id, count(distinct p) n_hit from (
    select doc_id, unnest(generate_series(i, i + n - 1)) p from hits) group by 1),
its as (select doc_id, count(distinct item_id) n_items,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hits group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
    coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join pos using (doc_id) left join its using (doc_id)""")
def op5_benchmark_decontamination(spark, sf_dir):
    judged = decontaminate.contamination(_table(spark, sf_dir, "documents"),
                                         _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return judged.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


@query("""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws
           from documents),
w as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) h
      from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) i from d where len(ws) >= 50)),
low as (select h, min(doc_id) first from w group by h),
cut as (select doc_id, list_distinct(flatten(list(generate_series(i, i + 49)))) gone
        from w join low using (h) where doc_id > first group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
    sha256(case when gone is null then array_to_string(ws, ' ') else array_to_string(
        list_filter(ws, lambda x, i: not list_contains(gone, i)), ' ') end) kept_sha256
from d left join cut using (doc_id)""")
def op8_substring_dedup(spark, sf_dir):
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_token_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    read = tokenfile.read_tokens(tokenfile.write_tokens(docs), docs)
    return read.select("doc_id", "start", (F.octet_length("payload") / 4).cast("long").alias("n_tokens"),
                       F.crc32("payload").alias("ids_crc32"))


@query()
def op10_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op6_html_extraction(spark, sf_dir):
    return webpages.extract_text(_table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


@query()
def op4_lm_scoring(spark, sf_dir):
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


@query("""
with l as (select doc_id, no, list_distinct(list_filter(regexp_split_to_array(line,
        '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ws
    from (select doc_id, unnest(string_split(text, chr(10))) line,
          unnest(generate_series(1, len(string_split(text, chr(10))))) no from documents)),
sets as (select list_sort(ws) ws, min((doc_id, no)) place, row_number() over () id
    from l where len(ws) > 0 group by list_sort(ws)),
df as (select w, count(*) n from (select unnest(ws) w from sets) group by w),
ranked as (select id, len(ws) n, u.w, row_number() over (partition by id order by df.n, df.w) r
    from (select id, ws, unnest(ws) w from sets) u join df using (w)),
prefix as (select id, n, w from ranked where r <= n - ceil(n * 4 / 5) + 1),
cand as (select distinct x.id a, y.id b from prefix x join prefix y using (w)
    where x.id <> y.id and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n),
links as (select a, b from cand join sets s on a = s.id join sets t on b = t.id
    where 9 * len(list_intersect(s.ws, t.ws)) >= 4 * (len(s.ws) + len(t.ws))),
best as (select a id, min(place) place from links join sets on b = sets.id group by a),
bound as (select s.ws, least(s.place, coalesce(best.place, s.place)) place
    from sets s left join best using (id)),
gone as (select doc_id, list(no) nos from l join bound on list_sort(l.ws) = bound.ws
    where (doc_id, no) > bound.place group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint n_lines,
    coalesce(len(nos), 0)::bigint n_removed,
    sha256(coalesce(case when nos is null then text else array_to_string(list_filter(
        string_split(text, chr(10)), lambda x, i: not list_contains(nos, i)), chr(10)) end, '')) kept_sha256
from documents left join gone using (doc_id)""")
def op2_line_dedup(spark, sf_dir):
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(
        F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("""
with e as (select vec_id, label, list_transform(embedding, lambda x: coalesce(x, 0)::double) v,
    coalesce(label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) ok from embeddings),
good as (select * from e where ok),
links as (select a.vec_id a, b.vec_id b from good a join good b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (with recursive r(a, b) as (select vec_id, vec_id from e union
    select r.a, links.b from r join links on r.b = links.a) select a, min(b) root from r group by a),
n as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0)::bigint n_links, root component_id, vec_id = root kept
from e join reach on vec_id = reach.a left join n on vec_id = n.a""")
def op3_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def _merkle_sql(levels: int = 16) -> str:
    """DuckDB SQL of the manifest: levels written out, CRC-32 bit by bit."""
    def field(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::varchar))::varchar || ':' || {name}::varchar, '-')"

    def tree(start: str, name: str) -> str:
        out = f"{name}0 as (select tree, pos, digest d, n from {start}),\n"
        for k in range(1, levels + 1):
            out += f"""{name}{k} as (select tree, p pos, d, count(*) over (partition by tree) n from (
                select tree, pos // 3 p, case when any_value(n) = 1 then any_value(d)
                else sha256(string_agg(d, '' order by pos)) end d from {name}{k - 1} group by tree, pos // 3)),\n"""
        return out

    def path(name: str) -> str:
        """Siblings of the leaf at each level: digests before and after the own one."""
        return ",\n".join(f"""{name}_s{k} as (select x.tree, x.pos, coalesce(string_agg(y.d, '' order by y.pos)
            filter (where y.pos < x.pos), '') bef, coalesce(string_agg(y.d, '' order by y.pos)
            filter (where y.pos > x.pos), '') aft from {name}{k} x join {name}{k} y
            on x.tree is not distinct from y.tree and x.pos // 3 = y.pos // 3
            where x.n > 1 group by x.tree, x.pos)""" for k in range(levels))

    def climb(name: str, first: str, start: str) -> str:
        out, last = "", start
        for k in range(levels):
            out += f"""{first}{k} as (select f.* replace (
                coalesce(sha256(s.bef || f.folded || s.aft), f.folded) as folded,
                f.proof || coalesce(s.bef || s.aft, '') as proof) from {last} f left join {name}_s{k} s
                on f.{name}_tree is not distinct from s.tree and f.{name}_pos // {3 ** k} = s.pos),\n"""
            last = f"{first}{k}"
        return out
    cut = "case when text is null then '-' else octet_length(encode(replace(text, chr(10), '')))::varchar || ':' || replace(text, chr(10), '') end"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""with d0 as (select doc_id, source, sha256({rest} || {field('text')}) leaf, sha256({rest} || {cut}) cut,
    list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
        lambda h, c: list_reduce(list_concat([xor(h, c)], [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
            lambda x, _: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) crc from documents),
d as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 pos,
    count(*) over (partition by source) n from d0),
leaf_rows as (select source tree, pos, leaf digest, n from d),
{tree('leaf_rows', 'a')}
subs as (select tree source, d subroot, row_number() over (order by tree nulls first) - 1 pos,
    count(*) over () n from a{levels}),
sub_rows as (select 0 tree, pos, subroot digest, n from subs),
{tree('sub_rows', 'b')}
{path('a')},
{path('b')},
f as (select d.doc_id, d.leaf, s.subroot, d.source a_tree, d.pos a_pos, 0 b_tree, s.pos b_pos,
    case when xor(d.crc, 4294967295) % 2 = 0 then d.cut else d.leaf end folded, '' proof
    from d join subs s on d.source is not distinct from s.source),
{climb('a', 'fa', 'f')}
{climb('b', 'fb', f'fa{levels - 1}')}
z as (select d root from b{levels})
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, folded folded_root, folded = root verified
from fb{levels - 1}, z"""


@query()
def op11_quality_rules(spark, sf_dir):
    return outliers.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(_merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                      F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = merkle.merkle_manifest(_table(spark, sf_dir, "documents"), tampered).leaves
    folded = leaves.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("changed", "digest")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root",
                         F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
