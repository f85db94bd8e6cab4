"""The thin queries over the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simplexa.llm import ann, bpe, centroid_clustering, decontam, exact_dedup, html_extract, jaccard_join, line_dedup, lm, phrases, secret_scan, substring_dedup, toxicity
from simplexa.llm.common import read_table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), *tokenizer())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))[0]


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_substring_dedup": op2_substring_dedup, "op3_line_dedup": op3_line_dedup, "op4_lm_scoring": op4_lm_scoring, "op5_toxicity": op5_toxicity, "op6_decontamination": op6_decontamination, "op7_html_extraction": op7_html_extraction, "op8_secrets": op8_secrets, "op9_nearest_neighbours": op9_nearest_neighbours, "op10_jaccard_join": op10_jaccard_join, "op11_exact_dedup": op11_exact_dedup, "op12_centroid_clustering": op12_centroid_clustering, "op13_phrase_collocations": op13_phrase_collocations}


#: Words are joined by a space, which none of them holds.
_OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') as k from d, unnest(range(1, len(w) - 18)) t(s)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from windows) where n > 1),
gone as (select distinct doc_id, i from later, unnest(range(s, s + 20)) t(i)),
kept as (select d.doc_id, string_agg(d.w[i], ' ' order by i) as t from d, unnest(range(1, len(d.w) + 1)) x(i) where not exists (select 1 from gone g where g.doc_id = d.doc_id and g.i = x.i) group by d.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (select count(*) from gone g where g.doc_id = d.doc_id)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""

_OP6 = r"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item, w, least(10, len(w)) as n from items where len(w) > 0),
pats as (select distinct item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as k from sized, unnest(range(1, len(w) - n + 2)) t(s)),
lens as (select distinct n from pats),
wins as (select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as k from words, lens, unnest(range(1, len(w) - n + 2)) t(s)),
found as (select doc_id, item, n, s from wins join pats using (n, k)),
hit as (select doc_id, count(distinct i) as h from found, unnest(range(s, s + n)) t(i) group by 1),
its as (select doc_id, count(*) as c, string_agg(item, ',' order by item) as l from (select distinct doc_id, item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(h, 0)::bigint as n_hit, coalesce(c, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated
from words left join hit using (doc_id) left join its using (doc_id)
"""

_OP10 = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as materialized (select distinct doc_id, array_to_string(list_slice(w, s, s + 2), ' ') as k from w, unnest(range(1, greatest(len(w) - 1, 2))) t(s) where len(w) > 0),
size as materialized (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
both_ways as materialized (select a, b from links union select b, a from links),
reach(v, r) as (select a, b from both_ways union select reach.v, e.b from reach join both_ways e on e.a = reach.r)
select w.doc_id, coalesce(size.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce((select min(r) from reach where v = w.doc_id), w.doc_id)) as component_id
from w left join size using (doc_id)
"""


_OP11 = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from t join g using (t)
"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    """Every round as two views: distances to the nearest centroid, then floors of means (``//`` truncates)."""
    fine = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64"
    views = [
        f"kept as materialized (select row_number() over () as r, vec_id, embedding as e, sha256('3:' || vec_id::varchar) as h from embeddings where {fine})",
        "x as materialized (select r, i, floor(1024 * e[i]::double)::bigint as v from kept, unnest(range(1, 65)) t(i))",
        f"c0 as materialized (select s.k, x.i, x.v from (select r, row_number() over (order by h nulls last, e) - 1 as k from kept order by h nulls last, e limit {k}) s join x using (r))",
    ]
    for n in range(rounds + 1):
        views.append(f"a{n} as materialized (select r, arg_min(k, d * {k} + k) as k, min(d) as d from (select x.r, c.k, sum((x.v - c.v) * (x.v - c.v))::bigint as d from x join c{n} c using (i) group by 1, 2) group by r)")
        if n < rounds:
            views.append(f"m{n} as materialized (select a.k, x.i, sum(x.v)::bigint as s, count(*) as n from a{n} a join x using (r) group by 1, 2)")
            views.append(f"c{n + 1} as materialized (select c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v) as v from c{n} c left join m{n} m on m.k = c.k and m.i = c.i)")
    last = f"select vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, f.s as centroid_sha256 from kept join a{rounds} a using (r) join (select k, sha256(string_agg(v::varchar, ',' order by i)) as s from c{rounds} group by k) f on f.k = a.k"
    return "with " + ", ".join(views) + " " + last


_OP13 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
g as materialized (select lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') as phrase, count(*) as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from w, unnest(range(1, 6)) t(k)) group by all having count(*) >= 100),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
c as materialized (select lang, phrase, f as a, k as words, string_split(phrase, ' ') as v from g where k >= 2),
held as (select lang, array_to_string(list_slice(v, s, s + k - 1), ' ') as phrase, max(a) as most from (select *, unnest(range(1, words - k + 2)) as s from c, unnest(range(2, 5)) t(k) where k < words) group by all),
cuts as (select c.lang, c.phrase, a, k, array_to_string(v[1:k], ' ') as x, array_to_string(v[k + 1:], ' ') as y from c left join held using (lang, phrase), unnest(range(1, 5)) t(k) where k < words and (most is null or 100 * most < 100 * a)),
s as (select cuts.lang, cuts.phrase, a, cuts.k as k, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score from cuts join g l on l.lang = cuts.lang and l.phrase = x join g r on r.lang = cuts.lang and r.phrase = y join n on n.lang = cuts.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as best from s)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from b where best = 1) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op6_decontamination": _OP6, "op10_jaccard_join": _OP10, "op11_exact_dedup": _OP11, "op12_centroid_clustering": _op12(), "op13_phrase_collocations": _OP13}
