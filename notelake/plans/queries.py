"""Queries over the note view, each with its DuckDB equivalent. as_of is fixed, so results don't depend on the day."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.text import title_tokens
from notelake.operators import edits, export, graph, index, parse, quality, recommend, runs, similarity, stats
from notelake.sources import vault
from notelake.sources.vault import view
from notelake.streaming.watch import latest_state

AS_OF = "2024-06-30 00:00:00"
SCORING = recommend.Scoring(merge=0.6)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WITH = r"""
with recursive n as (select count(*)::bigint c from documents),
notes as materialized (select doc_id, lang as vault, concat(source,'/note-',doc_id,'.md') as rel_path, concat('note-',doc_id) as title,
  concat(case when doc_id%3=0 then concat('---',chr(10),'keywords: [',lang,', ',source,']',chr(10),'---',chr(10)) else '' end,
    coalesce(text,''), chr(10),
    case when doc_id%5=0 then '' else concat('[[note-',(doc_id*7+3)%(select c from n),']] [[note-',(doc_id*13+5)%(2*(select c from
      n)),'|alias]]',chr(10)) end,
    case when doc_id%4=0 then '' else concat('#',lang,' #',source) end) as content,
  timestamp '2024-06-30 00:00:00' - (cast(doc_id%240 as int) * interval '1' day) as modified from documents),
cut as (select *, string_split(content, chr(10)) as ls from notes),
cut2 as (select *, case when trim(ls[1])='---' then coalesce(list_position(list_transform(ls[2:], lambda x: trim(x)), '---'), 0) else 0 end as e from
  cut),
v2 as materialized (select doc_id, vault, rel_path, title, content, modified, e > 0 as has_fm, case when e > 0 then ls[2:e] else [] end as block,
  case when e > 0 then array_to_string(ls[e+2:], chr(10)) else content end as body from cut2),
links2 as materialized (select rel_path, title, unnest(list_filter(list_transform(regexp_extract_all(body, '\[\[([^\[\]]+)\]\]', 1), lambda x:
  trim(split_part(split_part(x,'|',1),'#',1))), lambda x: x <> '')) as target from v2),
res as (select l.* from links2 l where target in (select title from v2)),
v1 as materialized (select title as name, vault, rel_path, content, modified,
  list_distinct(list_transform(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1), lambda x: trim(split_part(split_part(x,'|',1),'#',1)))) as og,
  list_distinct(regexp_extract_all(content, '#([\p{L}\p{M}\p{N}_\-/]+)', 1)) as tags,
  len(list_filter(regexp_split_to_array(regexp_replace(content, '(?s)```.*?```', '', 'g'), '\s+'), lambda x: x <> ''))::bigint as wc from notes),
edge as materialized (select name as src, d as dst from (select name, unnest(og) as d from v1) where d in (select name from v1)),
deg as materialized (select v1.name, len(og)::bigint as out_degree, coalesce(i.k, 0)::bigint as in_degree, len(og)::bigint + coalesce(i.k, 0)::bigint
  as total from v1 left join (select dst, count(*) k from edge group by 1) i on i.dst = v1.name),
age as (select *, date_diff('day', modified, timestamp '2024-06-30 00:00:00')::bigint as d from v1)
"""
_TERMS = r""",
tok as (select rel_path, lower(unnest(regexp_extract_all(body, '[A-Za-z0-9]{3,}'))) as term from v2),
cnt as (select rel_path, term, count(*) k from tok group by 1, 2),
top as materialized (select rel_path, term, k, row_number() over (partition by rel_path order by k desc, term) r from cnt qualify r <= 30),
tl as materialized (select v2.rel_path, v2.title, v2.has_fm, coalesce(list(top.term order by top.r) filter (top.term is not null), []) as terms from
  v2 left join top on top.rel_path = v2.rel_path group by 1, 2, 3)
"""
_PAIRS = (
    _TERMS
    + r""",
ls as (select rel_path, list_distinct(list(target)) as s from links2 group by 1),
tt as materialized (select tl.*, list_distinct(list_filter(regexp_split_to_array(lower(title), '[\s\-_]+'), lambda x: x <> '')) as w, coalesce(ls.s,
  []) as s from tl left join ls on ls.rel_path = tl.rel_path),
inter as materialized (select a.rel_path l, b.rel_path r, count(*) k from top a join top b on a.term = b.term and a.rel_path < b.rel_path group by 1,
  2),
raw0 as materialized (select a.rel_path l, b.rel_path r, a.title lt, b.title rt, coalesce(i.k / (len(a.terms) + len(b.terms) - i.k), 0.0)::double as
  raw,
  coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0.0)::double as ts, coalesce(len(list_intersect(a.s,
    b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 0.0)::double as lo,
  case when split_part(a.rel_path,'/',1) <> split_part(b.rel_path,'/',1) then 0.9 else 1.0 end::double as factor
  from tt a join tt b on a.rel_path < b.rel_path left join inter i on i.l = a.rel_path and i.r = b.rel_path),
hist as (select raw, count(*) m from raw0 group by 1),
q as materialized (select raw, m, ((2*(sum(m) over (order by raw) - m) + m - 1) / 2.0)::double / (select greatest(count(*) - 1, 1) from raw0)::double
  as q from hist),
p as materialized (select l, r, lt, rt, raw0.raw, q.q as cs, ts, lo, factor, least(greatest((q.q*0.6::double + ts*0.3::double +
  lo*0.1::double)*factor, 0.0::double), 1.0::double) as conf from raw0 join q on q.raw = raw0.raw),
both2 as (select l as rel_path, r as target_path, rt as target_title, conf from p where conf >= 0.3 union all select r, l, lt, conf from p where conf
  >= 0.3),
rel as materialized (select *, row_number() over (partition by rel_path order by conf desc, target_path) rank from both2 qualify rank <= 3)
"""
)
_META = (
    _PAIRS
    + r""",
best as (select rel_path, max(conf) c, list(target_title order by rank) t from rel group by 1),
meta as (select tt.rel_path, case when not has_fm and len(terms) > 0 then array_to_string(list_sort(terms)[1:3], ',') end as keywords, case when
  regexp_matches(title, '[-_]') then translate(title, '-_', '  ') end as aliases,
  array_to_string(t, ',') as related, coalesce(c, 0.25::double) as conf from tt left join best on best.rel_path = tt.rel_path)
"""
)
_STOP = ",".join(f"'{w}'" for w in similarity.STOP_WORDS)
_TFIDF = rf""",
cw as (select name, list_filter(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
  '(?s)```.*?```', '', 'g'), '\[\[.*?\]\]', '', 'g'), '\[.*?\]\(.*?\)', '', 'g'), '[#*_`]', '', 'g')), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x),
  lambda x: regexp_full_match(x, '[a-z]{{2,}}') and x not in ({_STOP})) as w, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9_]+'),
    lambda x: regexp_full_match(x, '[a-z]{{2,}}') and x not in ({_STOP}))) as tw, tags, og, wc from v1),
tf as materialized (select name, word, count(*) c from (select name, unnest(w) as word from cw) group by 1, 2),
tz as (select name, sum(c) s from tf group by 1), df as (select word, count(*) d from tf group by 1),
vec as materialized (select tf.name, tf.word, (c / s::double) * ln((select count(*) from v1)::double / d) as weight from tf join tz on tz.name =
  tf.name join df on df.word = tf.word),
nrm as (select name, sqrt(sum(weight*weight)) nn from vec group by 1),
unit as materialized (select vec.name, word, weight / nn as u from vec join nrm on nrm.name = vec.name where weight <> 0),
dots as materialized (select a.name l, b.name r, sum(a.u*b.u) c from unit a join unit b on a.word = b.word and a.name < b.name group by 1, 2),
sp0 as (select a.name l, b.name r, round(coalesce(dots.c, 0), 9) content, case when len(a.tw) = 0 or len(b.tw) = 0 then 0 else
  len(list_intersect(a.tw, b.tw)) / len(list_distinct(list_concat(a.tw, b.tw))) end as title,
  case when len(a.tags) = 0 or len(b.tags) = 0 then 0 else len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) end
    as tag, list_contains(a.og, b.name) or list_contains(b.og, a.name) as linked, a.wc wl, b.wc wr
  from cw a join cw b on a.name < b.name left join dots on dots.l = a.name and dots.r = b.name),
sp as materialized (select *, round(content*0.6::double + title*0.2::double + tag*0.2::double, 9) as sim, case when content > 0.5 then 'content' when
  title > 0.3 then 'title' when tag > 0.3 then 'tags' else 'mixed' end as reason from sp0)
"""
_QUAL = r""",
qs0 as (select age.name, wc, out_degree, in_degree, len(tags)::bigint n_tags, total t,
  case when wc < 100 then wc/100*50 when wc < 500 then 50 + (wc-100)/400*50 else 100 end::double as words,
  case when total = 0 then 0 when total < 2 then total/2*50 when total < 5 then 50 + (total-2)/3*50 else 100 end::double as links,
  case when len(tags) = 0 then 0 when len(tags) < 1 then 0 when len(tags) < 3 then 50 + (len(tags)-1)/2*50 else 100 end::double as tagscore,
  case when d <= 7 then 100 when d <= 30 then 90 when d <= 90 then 70 when d <= 180 then 50 else 30 end::double as freshness from age join deg on
    deg.name = age.name),
qs1 as (select *, words*0.25 + links*0.35 + tagscore*0.15 + freshness*0.25 as total from qs0),
qs as materialized (select *, case when total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' when total >= 60 then 'D' else 'F'
  end as grade from qs1)
"""


def _fixed(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles as millionths, so that both engines return the same values."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c * 1000000).cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _m(x: str) -> str:
    return f"cast(round(({x})*1000000) as bigint)"


#: Views in which few notes have links, and in which all have many links and tags and are new.
FEW_LINKS = {"linked": "doc_id % 3 = 0 and doc_id % 5 <> 0"}
RICH = {"end": " [[note-0]] [[note-1]] [[note-2]] [[note-3]] #one #two", "days": 9}


def _as_few_links(sql: str) -> str:
    return sql.replace("case when doc_id%5=0 then ''", "case when doc_id%5=0 or doc_id%3<>0 then ''")


def _as_rich(sql: str) -> str:
    sql = sql.replace("doc_id%240", f"doc_id%{RICH['days']}")
    return sql.replace("concat('#',lang,' #',source) end) as content", f"concat('#',lang,' #',source) end, '{RICH['end']}') as content")


def query(sql: str | None, prelude: str = "", view_of=lambda x: x):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf: _fixed(f(spark, sf))
        if sql:
            SQL[name] = view_of(_WITH) + prelude + sql if not sql.lstrip().lower().startswith("with") and prelude != "raw" else sql
        return f

    return add


def _v2(spark, sf):
    return parse.parse_v2(view(spark, sf))


def _links(spark, sf, **how):
    n = parse.split_frontmatter(view(spark, sf, **how)).withColumn("links", parse.links_v2(F.col("body")))
    return n.select("rel_path", "title", "has_frontmatter", "links")


def _v1(spark, sf, **how):
    """The view as one vault."""
    return parse.parse_v1(view(spark, sf, **how).withColumn("vault", F.lit("notes")))


@query(
    """select (select count(*) from v2)::bigint notes, (select count(*) from v2 where has_fm)::bigint frontmatter_notes, (select count(*) from
  links2)::bigint total_links, (select count(*) from res)::bigint resolved_links, (select count(distinct target) from links2 where target not in
  (select title from v2))::bigint broken_targets, (select count(*) from v2 where rel_path not in (select rel_path from links2) and title not in
  (select target from res))::bigint orphans"""
)
def health_summary(spark, sf):
    return graph.health(_links(spark, sf))


@query("select rel_path, target, count(*)::bigint k from res group by 1, 2")
def links_resolved(spark, sf):
    return graph.resolved(_links(spark, sf)).groupBy("rel_path", "target").agg(F.count("*").alias("k"))


@query("select distinct target from links2 where target not in (select title from v2) order by 1 limit 5")
def links_broken_top5(spark, sf):
    return graph.broken(_links(spark, sf)).orderBy("target").limit(5)


@query("select rel_path from v2 where rel_path not in (select rel_path from links2) and title not in (select target from res)")
def orphans_v2(spark, sf):
    return graph.orphans_v2(graph.saved(_links(spark, sf))).select("rel_path")


@query("select deg.name, strftime(modified, '%Y-%m-%d') as modified from deg join v1 on v1.name = deg.name where total = 0")
def orphans_v1(spark, sf):
    n = _v1(spark, sf)
    return graph.degrees(n).where("total = 0").drop("vault").join(n, "name").select("name", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


@query("select row_number() over (order by modified desc, deg.name)::bigint as place, deg.name from deg join v1 on v1.name = deg.name where total = 0 order by 1 limit 20")
def orphans_listed(spark, sf):
    """The first 20 orphans, last changed first, with their place."""
    n = _v1(spark, sf)
    d = graph.degrees(n).where("total = 0").join(n.select("vault", "name", "modified"), ["vault", "name"])
    return recommend.numbered(d.orderBy(F.desc("modified"), "name").limit(20).withColumn("m", -F.unix_micros(F.col("modified").cast("timestamp"))), "m", "name").select(F.col("number").alias("place"), "name")


@query("select dst as name, count(*)::bigint k, string_agg(src, ',' order by src) as sources from edge group by 1")
def backlinks(spark, sf):
    return graph.edges_v1(_v1(spark, sf)).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query("select * from deg")
def degree(spark, sf):
    return graph.degrees(_v1(spark, sf)).drop("vault")


@query("select name, out_degree from deg order by out_degree desc, name limit 10")
def hubs_top10(spark, sf):
    return graph.degrees(_v1(spark, sf)).orderBy(F.desc("out_degree"), "name").limit(10).select("name", "out_degree")


@query("select name, in_degree from deg order by in_degree desc, name limit 10")
def popular_top10(spark, sf):
    return graph.degrees(_v1(spark, sf)).orderBy(F.desc("in_degree"), "name").limit(10).select("name", "in_degree")


@query("select ((select count(*) from edge a join edge b on a.src = b.dst and a.dst = b.src) // 2)::bigint as bidirectional")
def reciprocal_edges(spark, sf):
    return graph.reciprocal_pairs(_v1(spark, sf))


@query("select a.src, a.dst, case when b.src is null then 'Unidirectional' else 'Bidirectional' end as kind from edge a left join edge b on a.src = b.dst and a.dst = b.src")
def link_type_export(spark, sf):
    return graph.labelled_edges(_v1(spark, sf)).drop("vault")


@query("select tag, count(*)::bigint notes from (select unnest(tags) as tag from v1) group by 1")
def tag_frequency(spark, sf):
    return stats.tag_frequency(_v1(spark, sf))


@query("select name from v1 where len(tags) = 0")
def untagged(spark, sf):
    return _v1(spark, sf).where(F.size("tags") == 0).select("name")


@query("select count(*) filter (d <= 7)::bigint within_7, count(*) filter (d <= 30)::bigint within_30, count(*) filter (d <= 90)::bigint within_90 from age")
def recency_buckets(spark, sf):
    return stats.recency(view(spark, sf), AS_OF)


@query(
    f"""select count(*)::bigint total_notes, sum(wc)::bigint total_words, sum(len(og))::bigint total_links, count(*) filter (len(tags)=0)::bigint untagged,
  (sum(wc) // count(*))::bigint avg_word_count, {_m('sum(len(og))/count(*)')} avg_links, count(*) filter (d <= 7)::bigint within_7, count(*) filter (d
  <= 30)::bigint within_30, count(*) filter (d <= 90)::bigint within_90, (select count(*) from deg where total = 0)::bigint orphans, (select
  count(distinct t) from (select unnest(tags) t from v1))::bigint unique_tags, ((select count(*) from edge a join edge b on a.src = b.dst and a.dst =
  b.src) // 2)::bigint bidirectional from age"""
)
def vault_stats(spark, sf):
    return stats.vault_stats(_v1(spark, sf), AS_OF)


_CLASH = r""",
k0 as (select * replace (concat('note-', (doc_id % (1 + (select c from n) // 3))::bigint) as title) from notes),
k1 as materialized (select title as name, * exclude (title), list_distinct(list_transform(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1), lambda
  x: trim(split_part(split_part(x,'|',1),'#',1)))) as og,
  list_distinct(regexp_extract_all(content, '#([\p{L}\p{M}\p{N}_\-/]+)', 1)) as tags,
  len(list_filter(regexp_split_to_array(regexp_replace(content, '(?s)```.*?```', '', 'g'), '\s+'), lambda x: x <> ''))::bigint as wc
  from (select *, row_number() over (partition by vault, title order by rel_path desc) as o from k0) where o = 1),
kedge as materialized (select e.vault, e.name as src, e.d as dst from (select vault, name, unnest(og) as d from k1) e join k1 t on t.vault = e.vault
  and t.name = e.d),
kdeg as materialized (select k1.vault, k1.name, len(og)::bigint as out_degree, coalesce(i.k, 0)::bigint as in_degree from k1 left join (select vault,
  dst, count(*) k from kedge group by all) i on i.vault = k1.vault and i.dst = k1.name)
"""


def _clash(spark, sf):
    """A vault a language, in which titles occur in several vaults and more than once in one."""
    n = view(spark, sf)
    third = F.lit(1 + n.count() // 3)
    return parse.parse_v1(n.withColumn("title", F.concat(F.lit("note-"), (F.col("doc_id") % third).cast("string"))))


@query(
    "select vault, count(*)::bigint notes, sum(wc)::bigint words, sum(len(og))::bigint links, count(*) filter (out_degree + in_degree = 0)::bigint orphans, "
    "(select count(distinct t) from (select vault v, unnest(tags) t from k1) u where u.v = x.vault or x.vault is null)::bigint unique_tags "
    "from (select k1.*, out_degree, in_degree from k1 join kdeg using (vault, name)) x group by rollup(vault)",
    _CLASH,
)
def multi_vault_rollup(spark, sf):
    return stats.rollup(_clash(spark, sf))


@query("select * from kdeg", _CLASH)
def multi_vault_degree(spark, sf):
    return graph.degrees(_clash(spark, sf)).drop("total")


@query("select vault, name, rel_path from k1 where contains(lower(name), 'then') or contains(lower(content), 'then')", _CLASH)
def multi_vault_search(spark, sf):
    return stats.search(_clash(spark, sf), keyword="Then").select("vault", "name", "rel_path")


@query("select vault, name, wc as word_count from k1 join kdeg using (vault, name) where out_degree + in_degree = 0", _CLASH)
def multi_vault_orphans(spark, sf):
    n = _clash(spark, sf)
    return graph.degrees(n).where("total = 0").join(n, ["vault", "name"]).select("vault", "name", "word_count")


@query("select name from v1 where contains(lower(name), 'then') or contains(lower(content), 'then')")
def search_keyword(spark, sf):
    return stats.search(_v1(spark, sf), keyword="Then").select("name")


@query("select name from v1 where list_contains(tags, 'en') and list_contains(tags, 'src1')")
def search_tags(spark, sf):
    return stats.search(_v1(spark, sf), tags=["en", "src1"]).select("name")


@query("select name from deg where total between 3 and 4")
def search_min_max_links(spark, sf):
    return stats.search(_v1(spark, sf), min_links=3, max_links=4).select("name")


@query("select name, wc as word_count from v1")
def word_count(spark, sf):
    return _v1(spark, sf).select("name", "word_count")


@query("select has_fm as has_frontmatter, count(*)::bigint notes from v2 group by 1")
def frontmatter_presence(spark, sf):
    return _links(spark, sf).groupBy("has_frontmatter").agg(F.count("*").alias("notes"))


@query(
    "select rel_path, case when doc_id%3=0 then concat(lang, ',', source) end as keywords, case when doc_id%2=0 then concat('alias ', doc_id, ',b') end as aliases, "
    "case when doc_id%5=0 then concat('note-', doc_id+1) end as related from (select n.*, d.lang, d.source from notes n join documents d using (doc_id))"
)
def frontmatter_fields(spark, sf):
    """Lists in brackets, items on lines of their own, single values, unknown keys and repeated values."""
    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "concat(source, '/note-', doc_id, '.md') as rel_path",
        """concat('---\n', case when doc_id%3=0 then concat('keywords: [', lang, ', ', source, ', ', lang, ']\n') else '' end, 'title: x\n- lost\n',
        case when doc_id%2=0 then concat('aliases:\n  - alias ', doc_id, '\n  -  b\n  - b\n') else '' end, case when doc_id%5=0 then
          concat('related:  note-', doc_id+1, '\n') else 'related: []\n' end, '---\n', coalesce(text, '')) as content""",
    )
    fm = parse.split_frontmatter(d).select("rel_path", parse.frontmatter(F.col("block")).alias("f"))
    return fm.select("rel_path", *[F.array_join(f"f.{k}", ",").alias(k) for k in ("keywords", "aliases", "related")])


@query("select rel_path, array_to_string(terms, ' ') as terms from tl", _TERMS)
def top_terms(spark, sf):
    return _v2(spark, sf).select("rel_path", F.array_join("top_terms", " ").alias("terms"))


@query(r"select title, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[\s\-_]+'), lambda x: x <> ''))), ' ') as words from v2")
def title_words(spark, sf):
    return view(spark, sf).select("title", F.array_join(F.array_sort(title_tokens(F.col("title"))), " ").alias("words"))


@query(f"select {_m('raw')} raw, m::bigint pairs from q where m > 0", _PAIRS)
def jaccard_pairs_hist(spark, sf):
    return recommend.AllPairs(_v2(spark, sf)).quantiles().select("raw", "pairs")


@query(f"select {_m('raw')} raw, {_m('q')} q from q", _PAIRS)
def quantile_norm(spark, sf):
    return recommend.AllPairs(_v2(spark, sf)).quantiles().select("raw", "q")


@query(f"select l, r, {_m('conf')} confidence from p where conf >= 0.5", _PAIRS)
def confidence_pairs(spark, sf):
    return recommend.AllPairs(_v2(spark, sf)).pairs(0.5, reasons=False)


@query(f"select l, r, {_m('conf')} confidence from p where conf >= 0.3", _PAIRS)
def confidence_pairs_all(spark, sf):
    """All pairs from the default minimum of recommendations on."""
    return recommend.AllPairs(_v2(spark, sf)).pairs(reasons=False)


@query(f"select rel_path, rank::bigint as rank, target_path, {_m('conf')} confidence from rel", _PAIRS)
def related_top3(spark, sf):
    return recommend.AllPairs(_v2(spark, sf)).suggestions().select("rel_path", "rank", "target_path", "confidence")


@query(f"select rel_path, keywords, aliases, related, {_m('conf')} confidence from meta", _META)
def metadata_suggestions(spark, sf):
    n = _v2(spark, sf)
    m = recommend.metadata(n, recommend.AllPairs(n).suggestions())
    return m.select("rel_path", F.array_join("keywords", ",").alias("keywords"), F.array_join("aliases", ",").alias("aliases"), F.array_join("related", ",").alias("related"), "confidence")


@query("select ((select count(*) from meta where conf < 0.45) + (select count(*) from rel where conf < 0.45))::bigint as low_confidence", _META)
def low_confidence_count(spark, sf):
    n = _v2(spark, sf)
    rel = graph.saved(recommend.AllPairs(n).suggestions())
    return recommend.low_confidence(recommend.metadata(n, rel), rel)


_COMP = r""",
me as (select l, r, conf from p where conf >= 0.6),
adj as (select l a, r b from me union select r, l from me),
reach(a, b) as (select a, a from adj union select reach.a, adj.b from reach join adj on adj.a = reach.b),
comp as materialized (select a as node, min(b) as component from reach group by 1),
mean as (select component, round_even(cast(avg(conf) as decimal(38,18)), 3)::double as average from me join comp on node = l group by 1),
clus as (select component, string_agg(node, ',' order by node) as candidates, any_value(average) as average from comp join mean using (component)
  group by 1)
"""


@query(f"select component, candidates, {_m('average')} average_confidence from clus", _PAIRS + _COMP)
def merge_components(spark, sf):
    """Clusters and the mean of their edges. The merge threshold is 0.6, as few pairs of these tables reach the default."""
    m = recommend.AllPairs(_v2(spark, sf), SCORING).merges()
    return m.select("component", F.array_join("candidates", ",").alias("candidates"), "average_confidence")


_PLAN = (
    _META
    + _COMP
    + r""",
act as (select row_number() over (order by part, key) as number, * from (
  select 1 part, target as key, 'create_stub_note' as type, 'A' as risk_class, concat(target, '.md') as target_path, 0.2::double as conf
    from (select distinct target from links2 where target not in (select title from v2) order by 1 limit 5)
  union all select 2, rel_path, 'append_related_links_section', 'A', rel_path, max(conf) from rel group by rel_path
  union all select 3, rel_path, 'add_frontmatter_fields', 'read-only', rel_path, conf from meta
  union all select 4, component, 'merge_preview', 'read-only', 'merge-preview', average from clus))
"""
)


def _plan(spark, sf):
    n = graph.saved(_v2(spark, sf))
    p = recommend.AllPairs(n, SCORING)
    rel = graph.saved(p.suggestions())
    return recommend.plan(graph.broken(n), rel, recommend.metadata(n, rel), p.merges())


@query(f"select format('act_{{:04d}}', number) as id, type, risk_class, target_path, {_m('conf')} confidence from act", _PLAN)
def plan_items(spark, sf):
    return _plan(spark, sf)


@query("select target_path, count(*)::bigint actions from act group by 1 order by 2 desc, min(number) limit 5", _PLAN)
def action_top_files(spark, sf):
    return edits.top_files(_plan(spark, sf))


@query(
    """select count(*)::bigint actions, count(distinct target_path)::bigint files from act where risk_class = 'A' and type in
  ('append_related_links_section', 'add_frontmatter_fields')""",
    _PLAN,
)
def action_summary(spark, sf):
    return edits.action_summary(edits.applicable(_plan(spark, sf)))


@query(f"select name, {_m('words')} words, {_m('links')} links, {_m('tagscore')} tags, {_m('freshness')} freshness, {_m('total')} total, grade from qs", _QUAL)
def quality_scores(spark, sf):
    return quality.scores(_v1(spark, sf), AS_OF).select("name", "words", "links", "tags", "freshness", "total", "grade")


@query(
    "select count(*)::bigint notes, " + _m("avg(total)") + " mean, " + _m("min(total)") + " lowest, " + _m("max(total)") + " highest, "
    + ", ".join(f"count(*) filter (grade = '{g}')::bigint grade_{g.lower()}" for g in "ABCDF") + ", "
    + ", ".join(f"count(*) filter ({c} < 50)::bigint low_{k}" for k, c in (("words", "words"), ("links", "links"), ("tags", "tagscore"), ("freshness", "freshness")))
    + f", {_m('(select total from (select total, row_number() over (order by total) - 1 i from qs) where i = (select count(*) // 2 from qs))')} median from qs",
    _QUAL,
)
def quality_summary(spark, sf):
    return quality.summary(quality.scores(_v1(spark, sf), AS_OF))


@query("select name, grade from qs where total < 70", _QUAL)
def quality_needs_improvement(spark, sf):
    return quality.scores(_v1(spark, sf), AS_OF).where("total < 70").select("name", "grade")


_HINTS = """array_to_string(list_filter([case when wc < 350 then 'words' end, case when links < 50 then 'links' end, case when n_tags = 0 then 'no_tags' end, case when n_tags > 6 then 'many_tags' end,
  case when freshness <= 50 then 'stale' end], lambda x: x is not null), ',')"""


@query(f"select name, {_HINTS} as hints from qs", _QUAL)
def quality_hints(spark, sf):
    return quality.scores(_v1(spark, sf), AS_OF).select("name", F.array_join("hints", ",").alias("hints"))


@query(f"select name, {_m('total')} total, {_HINTS} as hints from qs where {_HINTS} <> '' order by qs.total, name limit 10", _QUAL)
def quality_top_issues(spark, sf):
    return quality.top_issues(quality.scores(_v1(spark, sf), AS_OF)).select("name", "total", F.array_join("hints", ",").alias("hints"))


@query("select name, grade from qs where total >= 90", _QUAL)
def quality_excellent(spark, sf):
    return quality.scores(_v1(spark, sf), AS_OF).where("total >= 90").select("name", "grade")


@query("select name, grade from qs where contains(name, 'note-9') order by name limit 10", _QUAL)
def quality_find_part(spark, sf):
    """No note has this name, so those that hold it are meant."""
    return quality.find_notes(quality.scores(_v1(spark, sf), AS_OF), "NOTE-9").select("name", "grade")


@query("select name, grade from qs where name = 'note-9'", _QUAL)
def quality_find_exact(spark, sf):
    return quality.find_notes(quality.scores(_v1(spark, sf), AS_OF), "note-9").select("name", "grade")


@query("select name, grade from (select * from qs order by total, name limit 20) where grade = 'F'", _QUAL)
def quality_list_limit_then_grade(spark, sf):
    return quality.scores(_v1(spark, sf), AS_OF).orderBy("total", "name").limit(20).where("grade = 'F'").select("name", "grade")


@query(f"select name, word, {_m('weight')} weight from vec", _TFIDF)
def tfidf_vectors(spark, sf):
    return similarity.vectors(_v1(spark, sf)).select("name", "word", "weight")


@query(f"select l, r, {_m('sim')} similarity, reason from sp where sim >= 0.5", _TFIDF)
def similar_pairs(spark, sf):
    return similarity.similar_pairs(_v1(spark, sf), 0.5).select("l", "r", "similarity", "reason")


@query(f"select l, r, {_m('sim')} similarity, reason from sp where sim >= 0.3", _TFIDF)
def similar_pairs_all(spark, sf):
    """All pairs from the default minimum of 0.3 on."""
    return similarity.similar_pairs(_v1(spark, sf)).select("l", "r", "similarity", "reason")


@query(
    f"""select count(*)::bigint pairs, count(*) filter (sim >= 0.7)::bigint high, count(*) filter (sim >= 0.5 and sim < 0.7)::bigint medium, count(*) filter
  (sim < 0.5)::bigint low, {_m('avg(sim)')} mean, {_m('max(sim)')} highest, {_m('min(sim)')} lowest from sp where sim >= 0.45""",
    _TFIDF,
)
def similar_stats(spark, sf):
    return similarity.similar_stats(_v1(spark, sf), 0.45)


@query(
    f"""select count(*)::bigint pairs, count(*) filter (sim >= 0.7)::bigint high, count(*) filter (sim >= 0.5 and sim < 0.7)::bigint medium, count(*) filter
  (sim < 0.5)::bigint low, {_m('avg(sim)')} mean, {_m('max(sim)')} highest, {_m('min(sim)')} lowest from sp where sim >= 0.3""",
    _TFIDF,
)
def similar_stats_all(spark, sf):
    """Statistics of all pairs from the default minimum of 0.3 on."""
    return similarity.similar_stats(_v1(spark, sf))


@query("select l, r from sp where sim >= 0.7", _TFIDF)
def duplicates(spark, sf):
    return similarity.similar_pairs(_v1(spark, sf), 0.7).select("l", "r")


@query("select l, r, linked from sp where sim >= 0.6", _TFIDF)
def related_unlinked(spark, sf):
    n = _v1(spark, sf)
    return similarity.similar_pairs(n, 0.6, links=True).select("l", "r", "linked")


@query("select l, r, linked from sp where sim >= 0.3", _TFIDF)
def related_unlinked_all(spark, sf):
    """All pairs from the default minimum of 0.3 on."""
    n = _v1(spark, sf)
    return similarity.similar_pairs(n, links=True).select("l", "r", "linked")


@query(
    f"""select l, r, {_m('sim')} similarity, case when wl < 200 and wr < 200 then 'short' when reason = 'title' then 'similar_title' else 'similar' end as
  cause from sp where sim >= 0.6 and ((wl < 200 and wr < 200) or sim > 0.8)""",
    _TFIDF,
)
def merge_suggestions(spark, sf):
    return similarity.merge_pairs(_v1(spark, sf), 0.6).drop("vault")


@query(
    """select l, r, rank::bigint as rank, word from (select l, r, a.word, row_number() over (partition by l, r order by a.weight + b.weight desc, a.word) as
  rank from sp join vec a on a.name = l join vec b on b.name = r and b.word = a.word where sim >= 0.7) where rank <= 10""",
    _TFIDF,
)
def pair_common_words(spark, sf):
    return similarity.AllPairs(_v1(spark, sf), more=("text",)).common_words(0.7).drop("vault")


@query(
    f"""select case when l = 'note-99' then r else l end as other, {_m('sim')} similarity from sp where sim >= 0.3 and (l = 'note-99' or r = 'note-99') order
  by sim desc, 1 limit 5""",
    _TFIDF,
)
def similar_to_note(spark, sf):
    return similarity.to_note(_v1(spark, sf), "note-99").drop("vault")


def _diff(spark, sf):
    n = view(spark, sf).select("doc_id", "rel_path", (F.col("doc_id") * 1.0).cast("double").alias("mtime"), F.length("content").alias("size"))
    new = n.where("doc_id % 7 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return index.diff(n.where("doc_id % 11 <> 0 or doc_id % 7 = 0"), new)


_CHANGE = "case when doc_id%7=0 then 'removed' when doc_id%5=0 or doc_id%11=0 then 'updated' else 'unchanged' end"


@query(f"select rel_path, {_CHANGE} as change from notes")
def index_diff(spark, sf):
    return _diff(spark, sf)


@query(
    f"select *, {_m('round_even(unchanged / total::double, 3)')} hit_rate from (select count(*) filter (c <> 'removed')::bigint total, count(*) filter (c = 'unchanged')::bigint unchanged, "
    f"count(*) filter (c = 'updated')::bigint updated, count(*) filter (c = 'removed')::bigint removed from (select {_CHANGE} as c from notes))"
)
def index_counts(spark, sf):
    return index.counts(_diff(spark, sf))


#: Content with other line ends and marks: an initial byte order mark, CRLF throughout or once, one line; bytes that aren't UTF-8 are added by the query alone.
_FORMS = """select doc_id, concat(case when doc_id%5=0 then chr(65279) else '' end, case when doc_id%7=1 then replace(content, chr(10), concat(chr(13), chr(10)))
  when doc_id%7=2 then concat('first', chr(13), chr(10), content) when doc_id%7=3 then replace(content, chr(10), ' ') else content end) as t"""


@query(
    f"""forms as ({_FORMS} from notes), ends as (select doc_id, starts_with(t, chr(65279)) as bom, (len(t) - len(replace(t, concat(chr(13), chr(10)), ''))) //
  2 as crlf,
  len(t) - len(replace(t, chr(10), '')) as every from forms)
select count(*) filter (bom)::bigint bom, count(*) filter (doc_id%11=0)::bigint non_utf8, count(*) filter (every = 0)::bigint eol_none, count(*)
  filter (crlf > 0 and every > crlf)::bigint eol_mixed,
  count(*) filter (crlf > 0 and every = crlf)::bigint eol_crlf, count(*) filter (crlf = 0 and every > 0)::bigint eol_lf from ends""",
    ",",
)
def eol_encoding(spark, sf):
    forms = view(spark, sf).selectExpr(_FORMS.removeprefix("select doc_id, ").replace("chr(65279)", "decode(X'EFBBBF', 'utf-8')").removesuffix(" as t") + " as t", "doc_id")
    odd = F.when(F.col("doc_id") % 11 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    return parse.encoding(forms.select(F.concat(F.col("t").cast("binary"), odd).alias("content")))


@query(
    """with s as (select o_orderkey::bigint run_id, epoch(o_orderdate)::bigint mtime, o_custkey::bigint as size from orders) select run_id, mtime, size,
  (select max(mtime) from s) - mtime <= 86400 * 365 as keep from s"""
)
def retention_by_age(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_custkey").alias("size"))
    return runs.retention(o, o.agg(F.max("mtime")).first()[0], 86400 * 365)


@query(
    f"""select a.rel_path l, b.rel_path r, {_m('case when split_part(a.rel_path, chr(47), 1) <> split_part(b.rel_path, chr(47), 1) then 0.9 else 1.0 end')}
  factor from notes a join notes b on b.doc_id = (a.doc_id*7+3) % (select c from n)"""
)
def path_penalty(spark, sf):
    a = view(spark, sf)
    n = a.count()
    pairs = a.select("rel_path", ((F.col("doc_id") * 7 + 3) % n).alias("o")).join(a.select(F.col("doc_id").alias("o"), F.col("rel_path").alias("r")), "o")
    return pairs.select(F.col("rel_path").alias("l"), "r", parse.path_penalty(F.col("rel_path"), F.col("r")).alias("factor"))


@query(
    """with s as (select o_orderkey::bigint run_id, epoch(o_orderdate)::bigint mtime, o_custkey::bigint as size from orders), w as (select *, row_number()
  over (order by mtime desc, run_id desc) n, sum(size) over (order by mtime desc, run_id desc) upto from s) select run_id, mtime, size, (n <= 500 and
  upto <= 300000) as keep from w"""
)
def retention_running_size(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_custkey").alias("size"))
    return runs.retention(o, 0, None, 500, 300_000)


@query(
    """select v1.name, rel_path, wc as word_count, out_degree, in_degree, total as total_links, array_to_string(list_sort(tags), ', ') as tags,
  strftime(modified, '%Y-%m-%d %H:%M:%S') as modified, case when total = 0 then 'Yes' else 'No' end as orphan from v1 join deg on deg.name = v1.name"""
)
def notes_csv(spark, sf):
    return export.notes_rows(_v1(spark, sf)).drop("vault")


@query("select tag, count(*)::bigint notes, printf('%.1f%%', count(*)*100.0/(select count(*) from v1)) as share from (select unnest(tags) as tag from v1) group by 1")
def tags_csv(spark, sf):
    return export.tag_rows(_v1(spark, sf))


@query(
    f"""with x as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r, count(*) over (partition by user_id) k from events)
  select user_id, k::bigint events, event_type, {_m('value')} as value, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from x where r = 1"""
)
def watch_latest_state(spark, sf):
    return latest_state(spark.read.parquet(f"{sf}/events.parquet")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_BLOCK = f"## Related\n<!-- {edits.ANCHOR} -->\n- [[note-1]] (0.50)\n"
_SQL_BLOCK = "'" + _BLOCK.replace("\n", "' || chr(10) || '") + "'"
_SQL_WITH = f"case when contains(content, '{edits.ANCHOR}') then content else concat(content, case when ends_with(content, chr(10)) then '' else chr(10) end, {_SQL_BLOCK}) end"


@query(f"select rel_path, sha256({_SQL_WITH}) as digest from notes")
def apply_related_block(spark, sf):
    return view(spark, sf).select("rel_path", F.sha2(edits.append_block(F.col("content"), F.lit(edits.ANCHOR), F.lit(_BLOCK)), 256).alias("digest"))


@query("select rel_path, sha256(case when ends_with(content, chr(10)) then content else concat(content, chr(10)) end) as digest from notes")
def rollback_related_block(spark, sf):
    """The block is appended, a line follows it, and the block is removed again."""
    put = edits.append_block(F.col("content"), F.lit(edits.ANCHOR), F.lit(_BLOCK))
    return view(spark, sf).select("rel_path", F.sha2(edits.remove_block(put), 256).alias("digest"))


_SQL_ADDED = """case when has_fm then array_to_string(list_concat(['---'], block, ['aliases:', concat('  - n ', doc_id), concat('  - "a:', doc_id, '"'), '---'], case when body = '' then [] else [body] end), chr(10))
  else concat('---', chr(10), 'keywords:', chr(10), '  - k', chr(10), 'aliases:', chr(10), concat('  - n ', doc_id), chr(10), concat('  - "a:', doc_id, '"'), chr(10), '---', chr(10), content) end"""


@query(f"select rel_path, sha256({_SQL_ADDED}) as digest from v2")
def apply_frontmatter_fields(spark, sf):
    """Keywords are there in every third note and stay; aliases are new, one of them quoted."""
    i = F.col("doc_id").cast("string")
    fields = {"keywords": F.array(F.lit("k")), "aliases": F.array(F.concat(F.lit("n "), i), F.concat(F.lit("a:"), i)), "related": F.expr("cast(array() as array<string>)")}
    return view(spark, sf).select("rel_path", F.sha2(edits.add_fields(F.col("content"), fields), 256).alias("digest"))


@query(
    """select rel_path, sha256(case when has_fm then concat('---', chr(10), '---', chr(10), body) else concat('---', chr(10), 'keywords:', chr(10), '  - k',
  chr(10), '---', chr(10), content) end) as digest from v2"""
)
def rollback_frontmatter_keys(spark, sf):
    """Keys are added, then aliases removed, and keywords too where they were there before."""
    i = F.col("doc_id").cast("string")
    put = edits.add_fields(F.col("content"), {"keywords": F.array(F.lit("k")), "aliases": F.array(F.concat(F.lit("n "), i), F.lit("x"))})
    v = view(spark, sf).withColumn("content", put)
    keys = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("aliases"), F.lit("keywords"))).otherwise(F.array(F.lit("aliases")))
    return v.select("rel_path", F.sha2(edits.remove_keys(F.col("content"), keys), 256).alias("digest"))


@query(
    """select rel_path, sha256(replace(content, '[[note-13]]', '[[renamed]]')) as digest from (select rel_path, replace(content, '[[note-13|', '[[renamed|')
  as content from notes)"""
)
def rename_links(spark, sf):
    one = F.create_map(F.lit("note-13"), F.lit("renamed"))
    return view(spark, sf).select("rel_path", F.sha2(edits.rename_links(F.col("content"), one), 256).alias("digest"))


@query(
    "select vault, rel_path, sha256(replace(replace(content, concat('[[note-', a, ']]'), concat('[[', case when a%10=0 then 'new ' else 'note-' end, a, ']]')), concat('[[note-', b, '|'), concat('[[', case when b%10=0 then 'new ' else 'note-' end, b, '|'))) as digest "
    "from (select *, (doc_id*7+3)%(select c from n) as a, (doc_id*13+5)%(2*(select c from n)) as b from notes) where doc_id%5<>0 and (a%10=0 or b%10=0)"
)
def rename_map_all(spark, sf):
    """Every tenth title, also of notes that don't exist, gets a new name in one pass over all notes."""
    v = view(spark, sf)
    number = v.select("vault").distinct().select("vault", F.explode(F.sequence(F.lit(0), F.lit(2 * v.count() - 1), F.lit(10))).alias("i"))
    renames = number.select("vault", F.concat(F.lit("note-"), F.col("i").cast("string")).alias("old"), F.concat(F.lit("new "), F.col("i").cast("string")).alias("new"))
    return edits.rename_all(v, renames).select("vault", "rel_path", F.sha2("content", 256).alias("digest"))


@query(
    """select distinct concat('act-', (doc_id*7+3)%(2*(select c from n))) as dependency from notes where doc_id%5<>0 and (doc_id*7+3)%(2*(select c from n))
  not in (select doc_id from notes)"""
)
def missing_dependencies(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    name = lambda c: F.concat(F.lit("act-"), c.cast("string"))
    needs = F.when(F.col("doc_id") % 5 != 0, F.array(name((F.col("doc_id") * 7 + 3) % (2 * d.count())))).otherwise(F.expr("cast(array() as array<string>)"))
    return edits.missing_dependencies(d.select(name(F.col("doc_id")).alias("id"), needs.alias("dependencies")))


@query("with x as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) select page_id, count(*)::bigint links, count(distinct href)::bigint distinct_links from x group by 1")
def page_links(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    x = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return x.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"))


# On views where these results have rows.


@query("select rel_path from v2 where rel_path not in (select rel_path from links2) and title not in (select target from res)", view_of=_as_few_links)
def orphans_v2_few_links(spark, sf):
    return graph.orphans_v2(graph.saved(_links(spark, sf, **FEW_LINKS))).select("rel_path")


@query("select deg.name, strftime(modified, '%Y-%m-%d') as modified from deg join v1 on v1.name = deg.name where total = 0", view_of=_as_few_links)
def orphans_v1_few_links(spark, sf):
    n = _v1(spark, sf, **FEW_LINKS)
    return graph.degrees(n).where("total = 0").drop("vault").join(n, "name").select("name", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


@query(
    """select row_number() over (order by modified desc, deg.name)::bigint as place, deg.name from deg join v1 on v1.name = deg.name where total = 0 order by
  1 limit 20""",
    view_of=_as_few_links,
)
def orphans_listed_few_links(spark, sf):
    """The first 20 orphans, last changed first, with their place."""
    first = export.orphan_rows(_v1(spark, sf, **FEW_LINKS)).limit(20).withColumn("m", -F.unix_micros(F.col("modified").cast("timestamp")))
    return recommend.numbered(first, "m", "name").select(F.col("number").alias("place"), "name")


@query(
    """select v1.name as "Note Name", wc as "Word Count", array_to_string(list_sort(tags), ', ') as "Tags", strftime(modified, '%Y-%m-%d %H:%M:%S') as
  "Modified Date", rel_path as "Path"
  from v1 join deg on deg.name = v1.name where total = 0""",
    view_of=_as_few_links,
)
def orphans_csv(spark, sf):
    return export.orphans_table(_v1(spark, sf, **FEW_LINKS))


@query("select name, grade from qs where total >= 90", _QUAL, _as_rich)
def quality_excellent_rich(spark, sf):
    return quality.scores(_v1(spark, sf, **RICH), AS_OF).where("total >= 90").select("name", "grade")


@query(
    r"""select rel_path, concat('## Related', chr(10), '<!-- """
    + edits.ANCHOR
    + r""" -->', chr(10), string_agg(concat('- [[', target_title, ']] (',
    printf('%.2f', round_even(cast(conf as decimal(38,18)), 2)::double), ')'), chr(10) order by rank), chr(10)) as block
  from rel group by 1""",
    _PAIRS,
)
def related_blocks(spark, sf):
    return recommend.related_blocks(recommend.AllPairs(_v2(spark, sf)).suggestions()).select("rel_path", F.col("markdown_block").alias("block"))


_DIGITS = "round_even(cast({} as decimal(38,18)), 3)::double"


@query(
    f"""select rel_path, rank::bigint as rank,
  {", ".join(_m(_DIGITS.format(c)) + " as " + n for c, n in (("cs", "content_sim"), ("ts", "title_sim"), ("lo", "link_overlap"), ("raw", "raw_content_sim")))},
  case when factor < 1 then 'path_penalty=0.90' else '' end as filters, 'quantile' as norm_method
  from rel join p on p.l = least(rel.rel_path, rel.target_path) and p.r = greatest(rel.rel_path, rel.target_path)""",
    _PAIRS,
)
def suggestion_reasons(spark, sf):
    d = recommend.AllPairs(_v2(spark, sf)).suggestions().withColumn("why", recommend.reason())
    parts = [F.col(f"why.{c}").alias(c) for c in ("content_sim", "title_sim", "link_overlap", "raw_content_sim")]
    return d.select("rel_path", "rank", *parts, F.array_join("why.filters", ",").alias("filters"), F.col("why.norm_method").alias("norm_method"))


@query(
    """select case when doc_id % 7 = 0 then 'missing' else 'changed' end as reason, count(*)::bigint as conflicts from v2 where doc_id % 7 = 0 or doc_id % 11
  = 0 group by 1"""
)
def conflict_counts(spark, sf):
    """Actions for every note, after each seventh note has gone and each eleventh has changed."""
    n = view(spark, sf).select("doc_id", "rel_path", F.sha2("content", 256).alias("sha256"))
    items = n.select(F.format_string("act_%04d", "doc_id").alias("id"), F.col("rel_path").alias("target_path"))
    now = n.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 11 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return edits.conflict_summary(edits.conflicts(items, n, now))


# Scans, exclusions and digests, on listings that the tables' rows make.


def _listing(spark, sf):
    """Files as a scan lists them: every fifth name isn't a note's, every eleventh can't be read, lengths are those of the contents."""
    n = view(spark, sf)
    path = F.when(F.col("doc_id") % 5 == 0, F.replace("rel_path", F.lit(".md"), F.lit(".png"))).when(F.col("doc_id") % 3 == 0, F.replace("rel_path", F.lit(".md"), F.lit(".MD"))).otherwise(F.col("rel_path"))
    d = n.select("vault", "doc_id", path.alias("rel_path"), F.octet_length("content").cast("long").alias("length"), (F.col("doc_id") % 11 != 0).alias("readable"))
    return d.withColumn("skipped", vault.skip_reason(0.004))


_SKIPS = f"""(select doc_id, case when doc_id % 11 = 0 then 'no_permission' when doc_id % 5 = 0 then 'non_md' when octet_length(encode(content)) >
  {int(0.004 * 1024 * 1024)} then 'too_large' end as reason from notes)"""


@query(f"select {', '.join(f"count(*) filter (reason = '{k}')::bigint as {k}" for k in ('non_md', 'too_large', 'no_permission'))} from {_SKIPS}")
def scan_skip_counts(spark, sf):
    return vault.skip_counts(_listing(spark, sf))


@query(f"select doc_id, reason from {_SKIPS} where reason is not null")
def scan_skipped(spark, sf):
    return _listing(spark, sf).where("skipped is not null").select("doc_id", F.col("skipped").alias("reason"))


@query("select rel_path, sha256(content) as sha256, octet_length(encode(content))::bigint as size from notes")
def note_digests(spark, sf):
    return view(spark, sf).select("rel_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


@query("select rel_path from notes where split_part(rel_path, '/', 1) not in ('src1', 'src7')")
def excluded_folders(spark, sf):
    return vault.exclude(view(spark, sf), ["src1", "src7"]).select("rel_path")


@query(r"select rel_path from notes where not regexp_full_match(title, 'note-.[13-5].*') and title <> 'note-2' and not regexp_full_match(title, '.*[^0-8]')")
def excluded_names(spark, sf):
    """Patterns with a star are globs; a name without one is meant literally, whatever other signs it has."""
    return vault.exclude(view(spark, sf), [], ["note-?[13-5]*", "note-2", "note-[0-9]", "*[!0-8]"]).select("rel_path")


@query("select vault, count(*)::bigint as notes, sum(octet_length(encode(content)))::bigint as bytes from notes group by 1")
def vault_union(spark, sf):
    """The vaults of the view, scanned one by one and put together."""
    n = view(spark, sf)
    out = None
    for name in ("de", "en", "es", "fr"):
        one = n.where(F.col("vault") == name)
        out = one if out is None else out.unionByName(one)
    rest = n.where(~F.coalesce(F.col("vault").isin("de", "en", "es", "fr"), F.lit(False)))
    return out.unionByName(rest).groupBy("vault").agg(F.count("*").alias("notes"), F.sum(F.octet_length("content")).alias("bytes"))


@query("select (sum(len(terms)) * 16)::bigint as bytes from tl", _TERMS)
def memory_estimate(spark, sf):
    """What recommendations are estimated to need, before any is made."""
    return _v2(spark, sf).agg((F.sum(F.size("top_terms")) * 16).alias("bytes"))


@query("select tag, count(*)::bigint as notes from (select unnest(tags) as tag from v1) group by 1 order by 2 desc, 1 limit 10")
def common_tags(spark, sf):
    return stats.tag_frequency(_v1(spark, sf)).select("tag", "notes").orderBy(F.desc("notes"), "tag").limit(10)


@query(
    r"""select rel_path, concat('{"items":[', string_agg(concat('{"title":"', target_title, '","confidence":', printf('%.3f', round_even(cast(conf as
  decimal(38,18)), 3)::double), ',"target_path":"', target_path, '"}'), ',' order by rank), ']}') as payload
  from rel group by 1""",
    _PAIRS,
)
def suggestion_payloads(spark, sf):
    """Suggestions of each note as JSON, confidences with three decimals."""
    rel = recommend.AllPairs(_v2(spark, sf)).suggestions()
    number = F.format_string("%.3f", F.bround(F.col("confidence").cast("decimal(38,18)"), 3).cast("double"))
    plain = F.concat(F.lit('{"title":"'), "target_title", F.lit('","confidence":'), number, F.lit(',"target_path":"'), "target_path", F.lit('"}'))
    rows = rel.groupBy("rel_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", plain.alias("x")))), lambda v: v["x"]).alias("xs"))
    payload = F.concat(F.lit('{"items":['), F.array_join("xs", ","), F.lit("]}"))
    return rows.select("rel_path", F.to_json(F.from_json(payload, "items array<struct<title:string,confidence:decimal(10,3),target_path:string>>")).alias("payload"))


def _index(spark):
    """An index of its own in the folder for intermediate tables."""
    graph.saved(spark.range(0))  # sets that folder where it is unset
    return index.Snapshot(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}")


def _indexed(spark, sf):
    """The notes' digests as an index: all but each thirteenth written first; then these are added, each seventh changed, each eleventh of the others removed."""
    n = view(spark, sf).select("doc_id", "rel_path", F.sha2("content", 256).alias("sha256"))
    s = _index(spark)
    s.write(n.where("doc_id % 13 <> 0"))
    new = n.where("doc_id % 13 = 0 or doc_id % 7 = 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    s.apply(new, n.where("doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 11 = 0").select("rel_path"), s.meta())
    return s


_INDEXED = """(select rel_path, case when doc_id % 7 = 0 then sha256(sha256(content)) else sha256(content) end as sha256 from notes where doc_id % 13 = 0 or doc_id
  % 7 = 0 or doc_id % 11 <> 0)"""


@query(f"select * from {_INDEXED}")
def index_after_update(spark, sf):
    s = _indexed(spark, sf)
    out = graph.saved(s.read().select("rel_path", "sha256"))
    s.delete()
    return out


@query(f"select * from {_INDEXED} where rel_path in (select rel_path from notes where doc_id in (77, 91, 121, 123))")
def index_lookups(spark, sf):
    """Notes by path: a changed, an added and changed, a removed and an untouched one."""
    s = _indexed(spark, sf)
    paths = [r.rel_path for r in view(spark, sf).where("doc_id in (77, 91, 121, 123)").select("rel_path").collect()]
    found = [s.found(p).select("rel_path", "sha256") for p in paths]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    out = graph.saved(out)
    s.delete()
    return out
