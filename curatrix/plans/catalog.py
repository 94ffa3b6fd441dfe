"""Every query of the curation engine over the driver's tables, with its SQL oracle.

The tables stand in for a curation run: documents are free-text dataset rows
(their source is the strategy), labels the critic's verdicts, benchmark the
reference texts, events the call log, and region, nation and part make two
taxonomies, which customers and parts are drawn from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import schema as J
from ..functions import text as T
from ..operators import browse, complexity, cost, coverage, diversity, sampling, similarity
from ..operators import taxonomy as X
from ..session import materialise, table
from ..sources import files
from ..streaming.resume import checkpoint_counts
from . import generated

SEED, TARGET, MODEL = 11, 60, "encoder-1"
LOW_THRESHOLD, LOW_N = "0.02", 5
TASKS = ["click", "purchase", "view"]
SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "note": {"type": "string"}}}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | generated.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | generated.SQL


# Text and set similarity.

_WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def _grams_sql(name: str, source: str, key: str, n: int) -> str:
    words = _WORDS.format("text")
    return f"""{name}_t as (select {key} as id, {words} as ws from {source}),
{name} as (select distinct id, array_to_string(ws[i + 1 : i + {n}], ' ') as g from (select id, ws, unnest(range(0, greatest(len(ws) - {n}, 0) + 1)) as i from {name}_t where len(ws) > 0)),
{name}_n as (select id, count(*) as n from {name} group by id)"""


def _pairs_sql(source: str) -> str:
    return f"""{_grams_sql("gr", source, "doc_id", 13)},
cl as (select id, min(id) over (partition by s) as class from (select id, md5(string_agg(g, '|' order by g)) as s from gr group by id)),
rg as (select gr.* from gr join cl on cl.id = gr.id and cl.id = cl.class),
pr as (select a.id as a_id, b.id as b_id, count(*) as shared from rg a join rg b on a.g = b.g and a.id < b.id group by 1, 2),
e as (select a_id, b_id, shared, x.n + y.n - shared as total from pr join gr_n x on x.id = a_id join gr_n y on y.id = b_id where 5 * shared >= 4 * (x.n + y.n - shared))"""


#: Removed ids of the greedy pass, unrolled: each step keeps what only removed rows precede, and removes what a kept one precedes.
_GREEDY = """r0 as (select -1 as id where false), """ + ", ".join(
    f"""k{i} as (select id from (select distinct a_id as id from e union select b_id from e) where id not in (select b_id from e where a_id not in (select id from r{i - 1}))),
r{i} as (select distinct b_id as id from e where a_id in (select id from k{i}))"""
    for i in range(1, 6)
) + ", gone as (select id from r5 union select id from cl where id <> class)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@_query(f"select doc_id, cast(len(ws) as integer) as n_tokens, cast(len(list_distinct(ws)) as integer) as n_distinct from (select doc_id, {_WORDS.format('text')} as ws from documents)")
def tokens_per_doc(spark, d):
    words = _documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("ws"))
    return words.select("doc_id", F.size("ws").alias("n_tokens"), F.size(F.array_distinct("ws")).alias("n_distinct"))


@_query(f"with {_grams_sql('gr', 'documents', 'doc_id', 13)} select id as doc_id, cast(n as integer) as n_grams from gr_n")
def ngram_stats(spark, d):
    return similarity.gram_sets(_documents(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("size").alias("n_grams"))


@_query(f"with {_pairs_sql('documents')} select a_id, b_id, cast(shared as integer) as shared, cast(total as integer) as total from e")
def dedupe_pairs(spark, d):
    """The similar pairs of classes of equal n-gram sets, each named by its first row; ``dedupe_classes`` has the rows."""
    sets = similarity.gram_sets(_documents(spark, d), "doc_id", "text")
    return similarity.similar_pairs(materialise(similarity.representatives(sets, similarity.classes(sets)))).withColumnRenamed("union", "total")


@_query(f"with {_pairs_sql('documents')}, li as (select id, count(*) as n from (select a_id as id from e union all select b_id from e) group by 1) select cl.id as doc_id, class as class_id, coalesce(n, 0) as links from cl left join li on li.id = class")
def dedupe_classes(spark, d):
    """Every row's class of equal n-gram sets, and how many other classes that is similar to."""
    sets = similarity.gram_sets(_documents(spark, d), "doc_id", "text")
    _, pairs, classed = similarity.removed_rows(sets)
    links = pairs.select(F.col("a_id").alias("class")).union(pairs.select("b_id")).groupBy("class").agg(F.count("*").alias("n"))
    return classed.join(links, "class", "left").select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("links"))


@_query(f"with {_pairs_sql('documents')}, {_GREEDY} select doc_id, lang, source, n_chars from documents where doc_id not in (select id from gone)")
def dedupe_kept(spark, d):
    return similarity.dedupe(_documents(spark, d), "doc_id", "text")[0].select("doc_id", "lang", "source", "n_chars")


@_query(
    f"""with {_pairs_sql('documents')}, {_GREEDY}
select (select count(*) from documents) as total, (select count(*) from e) as pairs, (select count(*) from gone) as removed_count,
       coalesce((select string_agg(id, ' ' order by id) from gone), '') as removed_ids"""
)
def dedupe_report(spark, d):
    docs = _documents(spark, d)
    removed, pairs, _ = similarity.removed_rows(similarity.gram_sets(docs, "doc_id", "text"))
    counts = removed.agg(F.count("*").alias("removed_count"), F.array_join(F.sort_array(F.collect_list("id")), " ").alias("removed_ids"))
    return docs.agg(F.count("*").alias("total")).crossJoin(pairs.agg(F.count("*").alias("pairs"))).crossJoin(counts)


def _contaminated_sql(n: int, den: int, num: int) -> str:
    return f"""with {_grams_sql("gr", "documents", "doc_id", n)}, {_grams_sql("rf", "benchmark", "item_id", n)},
c as (select a.id, b.id as ref, count(*) as shared from gr a join rf b on a.g = b.g group by 1, 2),
bad as (select distinct c.id from c join gr_n x on x.id = c.id join rf_n y on y.id = c.ref where {den} * shared >= {num} * (x.n + y.n - shared))
select doc_id, source from documents where doc_id not in (select id from bad)"""


@_query(_contaminated_sql(13, 5, 4))
def decontaminate_kept(spark, d):
    return similarity.decontaminate(_documents(spark, d), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")[0].select("doc_id", "source")


@_query(_contaminated_sql(LOW_N, 50, 1))
def decontaminate_low_threshold(spark, d):
    """Contamination as partial overlap: five-word runs, a small share of the union."""
    return similarity.decontaminate(_documents(spark, d), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", LOW_N, LOW_THRESHOLD)[0].select("doc_id", "source")


# Taxonomies.

_NODES = r"""base as (
  select 'geo' as factor, ['geo'] as path, 'places' as description, cast(1 as double) as weight
  union all select 'brand', ['brand'], 'goods', 1
  union all select 'geo', ['geo', r_name], 'region ' || r_regionkey, 1 + r_regionkey from region
  union all select 'geo', ['geo', r_name, n_name], 'nation ' || n_nationkey, 1 + n_nationkey % 3 from nation join region on n_regionkey = r_regionkey
  union all select 'brand', ['brand', p_brand], 'brand', count(*) from part group by p_brand
  union all select 'brand', ['brand', p_brand, p_type], 'type', count(*) from part group by p_brand, p_type),
inner_ as (select distinct factor, array_to_string(path[1 : len(path) - 1], '/') as ps from base where len(path) > 1),
nodes as (select base.factor, cast(row_number() over (partition by base.factor order by path) - 1 as integer) as ord, path[len(path)] as name, description, cast(len(path) - 1 as integer) as level,
                 path, array_to_string(path, '/') as path_str, regexp_replace(lower(array_to_string(path, '/')), '[^\p{L}\p{N}/]', '', 'g') as nkey, weight, inner_.ps is null as is_leaf
          from base left join inner_ on inner_.factor = base.factor and inner_.ps = array_to_string(path, '/')),
sh as (select *, weight / sum(weight) over (partition by factor, array_to_string(path[1 : level], '/')) as share from nodes)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    region, nation, part = (table(spark, d, t) for t in ("region", "nation", "part"))
    w = lambda c: c.cast("double")
    row = lambda f, path, about, weight: (F.lit(f).alias("factor"), F.array(*path).alias("path"), about.alias("description"), weight.alias("weight"))
    roots = spark.createDataFrame([("geo", ["geo"], "places", 1.0), ("brand", ["brand"], "goods", 1.0)], "factor string, path array<string>, description string, weight double")
    regions = region.select(*row("geo", [F.lit("geo"), F.col("r_name")], F.concat(F.lit("region "), "r_regionkey"), w(1 + F.col("r_regionkey"))))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*row("geo", [F.lit("geo"), F.col("r_name"), F.col("n_name")], F.concat(F.lit("nation "), "n_nationkey"), w(1 + F.col("n_nationkey") % 3)))
    brands = part.groupBy("p_brand").count().select(*row("brand", [F.lit("brand"), F.col("p_brand")], F.lit("brand"), w(F.col("count"))))
    types = part.groupBy("p_brand", "p_type").count().select(*row("brand", [F.lit("brand"), F.col("p_brand"), F.col("p_type")], F.lit("type"), w(F.col("count"))))
    every = roots.unionByName(regions).unionByName(nations).unionByName(brands).unionByName(types)
    rows = every.withColumn("name", F.element_at("path", -1)).withColumn("level", F.size("path") - 1)
    return materialise(X.complete(X.preorder(rows)))


STRATEGIES = [
    ("all", "Everything", ["geo", "brand"], 1.0, []),
    ("europe", "Europe with a few brands", ["geo/EUROPE", "brand/Brand#2", "brand.brand#4", "brand/Brand#3/SMALL"], 2.0, [["geo/EUROPE", "brand/Brand#4/SMALL"], ["geo/EUROPE"]]),
    ("open", "Paths that name nothing", ["nowhere/else", "nowhere/else"], 0.5, [["geo/ASIA", "brand"]]),
]
_STRATEGIES = (
    "roots(id, pos, root) as (values "
    + ", ".join(f"('{s[0]}', {k}, '{r}')" for s in STRATEGIES for k, r in enumerate([*s[2], *(x for p in s[4] if len(p) == 2 for x in p)]))
    + "), strat(id, w, n_roots) as (values "
    + ", ".join(f"('{s[0]}', cast({s[3]} as double), {len(s[2])})" for s in STRATEGIES)
    + "), rules(id, rule, a, b) as (values "
    + ", ".join(f"('{s[0]}', {k}, '{a}', '{b}')" for s in STRATEGIES for k, (a, b) in enumerate([[X_.lower().replace('#', '') for X_ in p] for p in s[4] if len(p) == 2]))
    + r"), keyed as (select id, pos, root, pos < n_roots as is_root, trim(regexp_replace(regexp_replace(replace(lower(root), '.', '/'), '[^\p{L}\p{N}/]', '', 'g'), '/+', '/', 'g'), '/') as key from roots join strat using (id))"
)


def _strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "id string, description string, roots array<string>, weight double, never_combine array<array<string>>")


@_query(f"with {_NODES} select factor, ord, name, description, level, path_str, nkey as key, weight, is_leaf from nodes")
def taxonomy_nodes(spark, d):
    return _nodes(spark, d).select("factor", "ord", "name", "description", "level", "path_str", F.array_join("path_key", "/").alias("key"), "weight", "is_leaf")


@_query(f"with {_NODES} select factor, level, count(distinct path_str) as total from nodes group by 1, 2")
def taxonomy_level_totals(spark, d):
    return X.level_totals(_nodes(spark, d))


@_query(
    f"""with {_NODES} select factor, count(*) as nodes, count(*) filter (where is_leaf) as leaves, max(level) as depth, count(*) filter (where not is_leaf) as parents,
round((count(*) - 1) / count(*) filter (where not is_leaf), 6) as branching from nodes group by 1"""
)
def tree_stats(spark, d):
    return X.statistics(_nodes(spark, d))


@_query(f"with {_NODES} select factor, string_agg(repeat('  ', level) || '- ' || name || ': ' || description, chr(10) order by ord) as outline from nodes group by 1")
def taxonomy_outline(spark, d):
    return X.outline(_nodes(spark, d))


@_query(f"with {_NODES} select factor, path_str as id, case when level > 0 then array_to_string(path[1 : level], '/') end as parent, level as depth from nodes")
def tree_flatten(spark, d):
    return X.flattened(_nodes(spark, d))


@_query(
    f"""with {_NODES} select distinct n.factor, n.path_str from nodes n join nodes x on x.factor = n.factor and (x.path_str = n.path_str or starts_with(x.path_str, n.path_str || '/'))
where contains(lower(x.name || ' ' || x.description || ' ' || x.path_str), 'nation 7')"""
)
def tree_search(spark, d):
    return X.search(_nodes(spark, d), " Nation 7 ")


@_query(f"with {_NODES} select l.factor, l.path_str, round(l.share * p.share, 9) as probability from sh l join sh p on p.factor = l.factor and p.path_str = array_to_string(l.path[1 : l.level], '/') where l.is_leaf")
def leaf_probability(spark, d):
    return sampling.leaf_probability(_nodes(spark, d)).withColumn("probability", F.round("probability", 9))


_DISTRIBUTION = f"""{_NODES}, {_STRATEGIES},
per as (select strat.id, n.factor, n.nkey as fkey from strat cross join (select factor, nkey from nodes where level = 0) n),
whole as (select distinct per.id, per.factor from per join keyed on keyed.id = per.id and is_root and key = fkey),
named as (select distinct keyed.id, n.factor, n.path_str as top, n.weight from keyed join nodes n on is_root and n.nkey = key and n.level > 0 where (keyed.id, n.factor) not in (select (id, factor) from whole)),
tops as (select *, weight / sum(weight) over (partition by id, factor) as p from named),
leaf as (select l.factor, l.path_str, l.share, l.share * p.share as p from sh l join sh p on p.factor = l.factor and p.path_str = array_to_string(l.path[1 : l.level], '/') where l.is_leaf),
dist as (select t.id, t.factor, l.path_str, sum(t.p * case when l.path_str = t.top then 1 else l.share end) as p from tops t join leaf l on l.factor = t.factor and (l.path_str = t.top or starts_with(l.path_str, t.top || '/')) group by 1, 2, 3
         union all select per.id, per.factor, l.path_str, l.p from per join leaf l on l.factor = per.factor where (per.id, per.factor) not in (select (id, factor) from tops))"""


@_query(f"with {_DISTRIBUTION} select id, factor, path_str, round(p, 9) as probability from dist")
def strategy_leaf_distribution(spark, d):
    return sampling.strategy_distribution(_strategies(spark), _nodes(spark, d)).withColumn("probability", F.round("probability", 9))


def _u(*parts: str) -> str:
    return "cast(('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 12)) as bigint) / 281474976710656.0"


_CHOSEN = f"""sc as (select id, round(sum(w / (select sum(w) from strat)) over (order by id), 9) as hi from strat),
si as (select id, coalesce(lag(hi) over (order by id), 0) as lo, hi from sc),
ch as (select c_custkey as attempt_index, si.id as strategy_id from (select c_custkey, {_u(f"'{SEED}'", "c_custkey", "'strategy'")} as u from customer) join si on u >= lo and u < hi)"""
_DRAWN = """dc as (select id, factor, path_str, round(sum(p) over (partition by id, factor order by path_str rows unbounded preceding), 9) as hi from dist),
di as (select id, factor, path_str, coalesce(lag(hi) over (partition by id, factor order by path_str), 0) as lo, hi from dc)"""


def _mix_sql(name: str, redraws: int) -> str:
    u = _u(f"'{SEED}'", "attempt_index", "factor", "redraw")
    return f"""{name} as (select attempt_index, strategy_id, redraw, q.factor, di.path_str
  from (select attempt_index, strategy_id, factor, redraw, {u} as u from ch join per on per.id = strategy_id cross join (select unnest(range(0, {redraws})) as redraw)) q
  join di on di.id = q.strategy_id and di.factor = q.factor and u >= lo and u < hi)"""


def _violating_sql(name: str, mixes: str) -> str:
    under = lambda side: f"bool_or(n.nkey = r.{side} or starts_with(n.nkey, r.{side} || '/'))"
    return f"""{name} as (select m.attempt_index, m.strategy_id, m.redraw, r.rule from {mixes} m join nodes n on n.factor = m.factor and n.path_str = m.path_str join rules r on r.id = m.strategy_id
  group by 1, 2, 3, 4 having {under("a")} and {under("b")})"""


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return sampling.choose_strategy(table(spark, d, "customer").select(F.col("c_custkey").alias("attempt_index")), _strategies(spark), SEED)


@_query(f"with {_STRATEGIES}, {_CHOSEN} select * from ch")
def choose_strategy(spark, d):
    return _chosen(spark, d)


@_query(f"with {_DISTRIBUTION}, {_CHOSEN}, {_DRAWN}, {_mix_sql('mx', 1)} select attempt_index, strategy_id, factor, path_str from mx")
def sample_mix_portable(spark, d):
    return sampling.sample_mix(_chosen(spark, d), materialise(sampling.strategy_distribution(_strategies(spark), _nodes(spark, d))), SEED)


@_query(f"with {_DISTRIBUTION}, {_CHOSEN}, {_DRAWN}, {_mix_sql('mx', 1)}, {_violating_sql('vi', 'mx')} select attempt_index, strategy_id, cast(rule as integer) as rule from vi")
def never_combine_violations(spark, d):
    return sampling.violations(sample_mix_portable(spark, d), _strategies(spark))


@_query(
    # No attempt needs as many redraws as the SQL has.
    f"""with {_DISTRIBUTION}, {_CHOSEN}, {_DRAWN}, {_mix_sql('mx', 16)}, {_violating_sql('vi', 'mx')},
ok as (select attempt_index, min(redraw) as redraw from mx where (attempt_index, redraw) not in (select (attempt_index, redraw) from vi) group by 1)
select attempt_index, strategy_id, factor, path_str from mx join ok using (attempt_index, redraw)"""
)
def sample_mix_valid(spark, d):
    distribution = materialise(sampling.strategy_distribution(_strategies(spark), _nodes(spark, d)))
    return sampling.sample_valid_mix(materialise(_chosen(spark, d)), distribution, _strategies(spark), SEED)


@_query()
def seeded_mixes(spark, d):
    """Draws by Python's generator, one seed an attempt: no SQL engine has it."""
    tree = X.to_tree(_nodes(spark, d))
    plans = [{"id": s[0], "roots": s[2], "weight": s[3], "never_combine": s[4]} for s in STRATEGIES]
    drawn = sampling.seeded_mixes(table(spark, d, "customer").select(F.col("c_custkey").alias("attempt_index")), tree, plans, SEED)
    return drawn.select("attempt_index", "strategy_id", F.array_join(T.mix_paths(F.col("taxonomy_mix")), " ").alias("mix"), "error")


@_query(f"with {_NODES}, {_STRATEGIES} select id, cast(pos as integer) as pos, root as ref from keyed where key not in (select nkey from nodes)")
def invalid_strategy_paths(spark, d):
    return X.invalid_paths(_strategies(spark), _nodes(spark, d))


@_query(f"with {_NODES}, {_STRATEGIES} select strat.id, n.factor from strat cross join (select factor, nkey from nodes where level = 0) n where not exists (select 1 from keyed where keyed.id = strat.id and is_root and split_part(key, '/', 1) = n.nkey)")
def uncovered_factors(spark, d):
    return X.uncovered_factors(_strategies(spark), _nodes(spark, d))


_WANTED = "wanted as (select distinct 'geo' as factor, upper(n_name) as wanted from nation union select 'brand', lower(p_type) from part union select 'brand', 'no such name')"


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    names = nation.select(F.lit("geo").alias("factor"), F.upper("n_name").alias("wanted")).union(part.select(F.lit("brand"), F.lower("p_type")))
    return names.union(spark.createDataFrame([("brand", "no such name")], "factor string, wanted string")).distinct()


@_query(f"with {_NODES}, {_WANTED} select w.factor, w.wanted, arg_min(n.path_str, n.ord) as path_str from wanted w join nodes n on n.factor = w.factor and lower(n.name) = lower(w.wanted) group by 1, 2")
def node_by_name(spark, d):
    return X.find_by_name(_nodes(spark, d), _wanted(spark, d)).select("factor", "wanted", F.array_join("path", "/").alias("path_str"))


# Coverage.


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    """(factor, path) of where customers live and what lines sell."""
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    lives = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sold = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lives.select(F.lit("geo").alias("factor"), F.array(F.lit("geo"), "r_name", "n_name").alias("path")).union(sold.select(F.lit("brand"), F.array(F.lit("brand"), "p_brand", "p_type")))


_LINEAGE = """lin as (select distinct 'geo' as factor, ['geo', r_name, n_name] as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union select 'brand', ['brand', p_brand, p_type] from lineitem join part on l_partkey = p_partkey)"""


def _coverage_sql(paths: str, nodes: str) -> str:
    return f"""pf as (select distinct factor, i - 1 as level, array_to_string(path[1 : i], '/') as node from (select factor, path, unnest(range(1, len(path) + 1)) as i from {paths})),
gt as (select factor, level, count(*) as covered, string_agg(node, ' | ' order by node) as nodes from pf group by 1, 2),
tt as (select factor, level, count(distinct path_str) as total from {nodes} group by 1, 2)
select tt.factor, tt.level, coalesce(covered, 0) as covered, total, round(coalesce(covered, 0) / total, 6) as ratio, coalesce(gt.nodes, '') as nodes from tt left join gt on gt.factor = tt.factor and gt.level = tt.level"""


def _listed(covered: DataFrame) -> DataFrame:
    return covered.withColumn("nodes", F.array_join("nodes", " | "))


@_query(f"with {_NODES}, {_LINEAGE}, {_coverage_sql('lin', 'nodes')}")
def coverage_lineage(spark, d):
    return _listed(coverage.coverage(_lineage(spark, d), _nodes(spark, d)))


@_query(f"with {_NODES}, {_LINEAGE}, known as (select * from nodes where factor = 'geo' and not contains(path_str, 'A')), {_coverage_sql('lin', 'known')}")
def coverage_off_tree(spark, d):
    """Rows that lie outside the tree still count: the ratio exceeds 1."""
    known = _nodes(spark, d).filter((F.col("factor") == "geo") & ~F.contains("path_str", F.lit("A")))
    return _listed(coverage.coverage(_lineage(spark, d), known))


@_query(
    f"""with {_NODES}, {_WANTED}, named as (select w.factor, arg_min(n.path, n.ord) as path from wanted w join nodes n on n.factor = w.factor and lower(n.name) = lower(w.wanted) group by w.factor, w.wanted),
{_coverage_sql('named', 'nodes')}"""
)
def coverage_reassigned(spark, d):
    return _listed(coverage.reassigned_coverage(_wanted(spark, d), _nodes(spark, d)))


def _trim_sql(rows: str, target: int) -> str:
    """The greedy choice over ``rows`` (ord, paths) as a recursion of one choice a step, then the rest in order."""
    return f"""sets as (select ps, min(ord) as ord from (select list_sort(list_distinct(paths)) as ps, ord from {rows}) group by ps),
pick(rank, used, ord) as (
  select cast(-1 as bigint), cast([] as varchar[]), cast(-1 as bigint)
  union all
  select rank + 1, list_distinct(list_concat(used, ps)), o from (
    select p.rank, p.used, s.ps, s.ord as o, row_number() over (order by len(s.ps) - len(list_intersect(s.ps, p.used)) desc, s.ord) as rn, len(s.ps) - len(list_intersect(s.ps, p.used)) as gain from pick p cross join sets s where p.rank + 1 < {target})
  where rn = 1 and gain > 0),
lead_ as (select ord, rank from pick where rank >= 0),
rest as (select ord, row_number() over (order by ord) - 1 + (select count(*) from lead_) as rank from {rows} where ord not in (select ord from lead_)),
trimmed as (select * from lead_ union all select * from rest where rank < {target})"""


_PATHS = "mixed as (select c_custkey as ord, ['geo:geo/' || r_name || '/' || n_name, 'segment:' || c_mktsegment] as paths from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def _customer_paths(spark: SparkSession, d: str) -> DataFrame:
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    entry = lambda f, path: F.struct(F.lit(f).alias("factor"), F.element_at(path, -1).alias("node"), path.alias("path"))
    mix = F.array(entry("geo", F.array(F.lit("geo"), "r_name", "n_name")), entry("segment", F.array("c_mktsegment")))
    return rows.select(F.col("c_custkey").alias("ord"), T.mix_paths(mix).alias("paths"))


@_query(f"with {_PATHS} select ord as c_custkey, array_to_string(paths, ' ') as paths from mixed")
def row_paths(spark, d):
    return _customer_paths(spark, d).select(F.col("ord").alias("c_custkey"), F.array_join("paths", " ").alias("paths"))


@_query(f"with recursive {_PATHS}, {_trim_sql('mixed', TARGET)} select ord, cast(rank as bigint) as rank from trimmed")
def coverage_trim(spark, d):
    return coverage.trim(spark, _customer_paths(spark, d), TARGET)


# Diversity.

_UNITS = "v as (select vec_id as id, cast(embedding as double[]) as v from {0}), u as (select id, v, sqrt(list_inner_product(v, v)) as n from v)"
_COSINE = "case when a.n > 0 and b.n > 0 then list_inner_product(a.v, b.v) / (a.n * b.n) else 0 end"


@_query(f"with {_UNITS.format('embeddings')} select (select count(*) from u) as count, round(avg(1 - {_COSINE}), 6) as global_diversity from u a join u b on a.id <> b.id")
def global_diversity(spark, d):
    return diversity.global_diversity(materialise(diversity.units(table(spark, d, "embeddings"), "vec_id", "embedding")))


@_query(
    f"""with cap as (select * from embeddings order by md5(vec_id::varchar), vec_id limit 1000), {_UNITS.format('cap')},
p as (select a.id, b.id as j, 1 - {_COSINE} as d from u a join u b on a.id <> b.id),
r as (select id, d from p qualify row_number() over (partition by id order by d, j) <= 10)
select (select count(*) from u) as count, round(avg(m), 6) as local_diversity from (select id, avg(d) as m from r group by id)"""
)
def local_diversity(spark, d):
    """Over the operator's own sample, as its cost is quadratic."""
    return diversity.local_diversity(materialise(diversity.units(diversity.capped(table(spark, d, "embeddings"), "vec_id", 1000), "vec_id", "embedding")))


@_query(
    f"""with k as (select doc_id, sha256('{MODEL}' || chr(0) || text) as key from documents)
select distinct key from k where key not in (select key from k join labels using (doc_id))"""
)
def diversity_cache_misses(spark, d):
    docs = _documents(spark, d)
    cached = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(T.cache_key(F.lit(MODEL), F.col("text")).alias("key"))
    return diversity.cache_misses(docs, cached, MODEL).select("key")


# Complexity.


@_query("select doc_id as id, round(avg(s), 6) as raw_score from (select doc_id, cast(10 * quality as double) as s from labels union all select doc_id, case when toxic = 1 then 9.5 else 5 end from labels) group by 1")
def complexity_raw_scores(spark, d):
    labels = table(spark, d, "labels")
    scored = labels.select(F.col("doc_id").alias("id"), (10.0 * F.col("quality")).alias("score")).union(labels.select("doc_id", F.when(F.col("toxic") == 1, 9.5)))
    return complexity.raw_scores(scored)


@_query()
def elo_ratings(spark, d):
    """An ordered fold over pairs: not expressible in SQL within reason."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), (10.0 * F.col("quality") - 3 * F.col("toxic")).alias("score"))
    return complexity.elo(rows, complexity.portable_schedule(rows, "ord", 5, 2), 2)


# Records.


@_query("""select event_id, json_type(props) = 'OBJECT' and json_type(props, '$.k') in ('UBIGINT', 'BIGINT') as valid, case when not (json_type(props) = 'OBJECT' and json_type(props, '$.k') in ('UBIGINT', 'BIGINT')) then '?' end as error from events""")
def schema_validate(spark, d):
    ok, error = J.validate(SCHEMA, F.try_parse_json("props"))
    return table(spark, d, "events").select("event_id", ok.alias("valid"), error.alias("error"))


@_query(
    """select event_id, event_type in ('error', 'signup') as strict_valid, event_type <> 'view' as has_json, case when event_type = 'view' then null else 'k=' || cast(json_extract(props, '$.k') as varchar) end as k from events"""
)
def json_extract_fenced(spark, d):
    """Answers that are JSON, fenced JSON, and prose: what is found in each, and whether it has a string ``note`` at most."""
    kind = F.col("event_type")
    prose = F.concat(F.lit("Sure, here: {"), "props")
    raw = F.when(kind.isin("error", "signup"), F.concat(F.lit(" \n"), "props", F.lit("\n"))).when(kind == "view", prose).otherwise(F.concat(F.lit("Here you are:\n```JSON\n"), "props", F.lit("\n```\nDone.")))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", T.extract_json(F.col("raw")).alias("j"))
    strict = F.try_parse_json("raw").isNotNull()
    return rows.select("event_id", strict.alias("strict_valid"), F.col("j").isNotNull().alias("has_json"), F.concat(F.lit("k="), T.dotted_field(F.col("j"), "$.k")).alias("k"))


@_query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.a.b'), props) as missing, 'x' || user_id as nested from events")
def dotted_field(spark, d):
    rows = table(spark, d, "events").withColumn("deep", F.to_json(F.struct(F.struct(F.concat(F.lit("x"), "user_id").alias("id")).alias("user"))))
    return rows.select("event_id", T.dotted_field(F.col("props"), "k").alias("k"), T.record_text(F.col("props"), "a.b").alias("missing"), T.record_text(F.col("deep"), "user.id").alias("nested"))


@_query("select event_id, case when event_type = 'click' then 'event_type user_id' else 'event_type k user_id' end as missing from events")
def key_difference(spark, d):
    """Keys that a record lacks of those that were asked for."""
    asked = F.to_json(F.struct(F.lit(1).alias("user_id"), F.lit(1).alias("event_type"), F.lit(1).alias("k")))
    have = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", F.lit("{}"))
    return table(spark, d, "events").select("event_id", F.array_join(T.key_difference(asked, have), " ").alias("missing"))


@_query(r"select page_id, regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(url), '.', '/'), '[^\p{L}\p{N}/]', '', 'g'), '/+', '/', 'g'), '/'), '/', '|', 'g') as key from pages")
def path_keys(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.root_key(F.col("url")), "|").alias("key"))


@_query("select item_id, text from benchmark")
def reference_texts(spark, d):
    """Reference lines as objects with a record, by way of JSON."""
    lines = table(spark, d, "benchmark").select("item_id", F.to_json(F.struct(F.col("text").alias("record"))).alias("line"))
    return lines.select("item_id", files.reference_text(F.col("line")).alias("text"))


@_query("select event_id, props as value from events where event_type <> 'error'")
def jsonl_tolerant(spark, d):
    """Lines of which those of one kind are torn."""
    torn = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return files.valid_lines(table(spark, d, "events").select("event_id", torn.alias("value")))


# Costs and browsing.

_CALLS = "calls as (select case when event_type = 'error' then 'critic' else 'bulk' end as role, event_type as task, 'model-' || (user_id % 3) as model, cast(json_extract(props, '$.k') as bigint) as in_tokens, length(props) as out_tokens, value as duration_seconds from events)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    role = F.when(F.col("event_type") == "error", "critic").otherwise("bulk")
    return e.select(
        role.alias("role"), F.col("event_type").alias("task"), F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"),
        F.get_json_object("props", "$.k").cast("long").alias("in_tokens"), F.length("props").cast("long").alias("out_tokens"), F.col("value").alias("duration_seconds"),
    )


_SUMS = "count(*) as calls, cast(sum(in_tokens) as bigint) as input_tokens, cast(sum(out_tokens) as bigint) as output_tokens, round(sum(duration_seconds), 3) as duration_seconds"


@_query(f"with {_CALLS} select role, task, model, {_SUMS}, false as is_total from calls group by role, task, model union all select null, null, null, {_SUMS}, true from calls")
def cost_summary(spark, d):
    return cost.summarize(_calls(spark, d))


@_query(f"with {_CALLS} select {_SUMS} from calls")
def cost_totals(spark, d):
    return cost.summarize(_calls(spark, d)).filter("is_total").drop("role", "task", "model", "is_total")


@_query(f"with {_CALLS} select task, round(sum(duration_seconds) / greatest(1, count(*)), 6) as avg_seconds from calls where task in ('click', 'purchase', 'view') group by 1")
def avg_call_time(spark, d):
    return cost.average_call_time(_calls(spark, d), TASKS)


@_query(f"with {_CALLS} select task, round(sum(in_tokens) / 1e6 * 0.05 + sum(out_tokens) / 1e6 * 0.40, 9) as cost from calls group by 1")
def cost_estimate(spark, d):
    sums = _calls(spark, d).groupBy("task").agg(F.sum("in_tokens").alias("i"), F.sum("out_tokens").alias("o"))
    return sums.select("task", F.round(T.cost_estimate(F.col("i"), F.col("o")), 9).alias("cost"))


@_query("select doc_id, cast(case when length(text) // 4 < 1 then 1 else length(text) // 4 end as bigint) as guess, cast(coalesce(nullif(quality, 0), greatest(1, length(text) // 4)) as bigint) as tokens from documents left join labels using (doc_id)")
def token_estimate(spark, d):
    rows = _documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", T.token_estimate(F.col("text")).alias("guess"), T.token_estimate(F.col("text"), F.col("quality")).alias("tokens"))


@_query(
    """with s as (select user_id, cast(round(sum(value) * 10) as bigint) as s from events group by 1)
select user_id, case when s >= 3600 then (s // 3600) || 'h' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' when s >= 60 then (s // 60) || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' else s || 's' end as spent from s"""
)
def duration_text(spark, d):
    """Values are added in the order of events: halves are rounded as their sum's last bits fall, which partial sums would change."""
    order = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = table(spark, d, "events").select("user_id", F.row_number().over(order).alias("n"), F.sum("value").over(order).alias("s"))
    return summed.groupBy("user_id").agg((F.max_by("s", "n") * 10).alias("s")).select("user_id", T.duration_text(F.col("s")).alias("spent"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as dataset rows; a document without a label isn't accepted."""
    rows = _documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.col("text").alias("record"), F.col("source").alias("strategy_id"), F.col("lang").alias("meta_prompt"), F.concat(F.lit("m-"), "lang").alias("generator_model"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("accepted"))


_ROWS = "r as (select doc_id, text as record, source as strategy_id, lang as meta_prompt, 'm-' || lang as generator_model, coalesce(quality = 1 and toxic = 0, false) as accepted from documents left join labels using (doc_id))"
_FOUND = "accepted and contains(lower(concat_ws(chr(10), record, strategy_id, meta_prompt)), 'src1')"


@_query(f"with {_ROWS} select doc_id, strategy_id, meta_prompt from r where accepted")
def accepted_rows(spark, d):
    return browse.apply_filters(_rows(spark, d), accepted_only=True).select("doc_id", "strategy_id", "meta_prompt")


@_query(f"with {_ROWS} select doc_id, strategy_id from r where {_FOUND}")
def viewer_search(spark, d):
    return browse.apply_filters(_rows(spark, d), " SRC1", None, True).select("doc_id", "strategy_id")


@_query(f"with {_ROWS}, f as (select doc_id, strategy_id, count(*) over () as n from r where {_FOUND}) select doc_id, strategy_id, (10 + 1) || '-' || least(n, 20) || ' of ' || n as range_label from f order by doc_id limit 10 offset 10")
def viewer_page(spark, d):
    """The second page of a search."""
    return browse.page(viewer_search(spark, d), 1, "doc_id")


@_query(f"with {_ROWS} select count(*) as rows, count(*) filter (where accepted) as accepted, count(distinct strategy_id) as strategies, count(distinct generator_model) as models from r")
def viewer_summary(spark, d):
    return browse.summary(_rows(spark, d))


@_query("select distinct source as strategy_id from documents where source is not null")
def strategy_options(spark, d):
    return browse.strategy_options(_rows(spark, d)).filter("strategy_id is not null")


@_query("select doc_id, source as strategy_id, case when source = 'src1' then 'The first' when source = 'src7' then 'The seventh' end as strategy_description from documents")
def strategy_lookup(spark, d):
    known = spark.createDataFrame([("src1", "The first"), ("src7", "The seventh"), ("other", "Of no row")], "id string, description string")
    return browse.with_strategy(_rows(spark, d), known).select("doc_id", "strategy_id", "strategy_description")


# Runs.


def _done(spark: SparkSession, d: str) -> DataFrame:
    """Judged documents as completed attempts; the number of the toxic ones is in their id only."""
    index = F.when(F.col("toxic") == 0, F.col("doc_id"))
    return table(spark, d, "labels").select(index.alias("attempt_index"), F.concat(F.lit("item-"), "doc_id", F.lit("-0a1b2c3d")).alias("id"), (F.col("quality") == 1).alias("accepted"))


@_query("select doc_id as attempt_index from documents where doc_id not in (select doc_id from labels)")
def resume_pending(spark, d):
    return browse.pending(_documents(spark, d).select(F.col("doc_id").alias("attempt_index")), _done(spark, d))


@_query("select 'item-' || doc_id || '-0a1b2c3d' as id, doc_id as attempt_index from labels")
def attempt_index_from_id(spark, d):
    return _done(spark, d).select("id", T.attempt_index(F.col("attempt_index"), F.col("id")).alias("attempt_index"))


@_query(
    """with c as (select doc_id // 100 + 1 as checkpoint, count(*) as n, count(*) filter (where quality = 1) as a from labels group by 1)
select checkpoint, cast(sum(n) over (order by checkpoint) as bigint) as attempted, cast(sum(a) over (order by checkpoint) as bigint) as accepted from c"""
)
def run_checkpoints(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("attempt_index"), (F.col("quality") == 1).alias("accepted"))
    return checkpoint_counts(rows, 100)


@_query(
    f"""with recursive acc as (select d.* from documents d join labels l using (doc_id) where quality = 1 and toxic = 0), {_pairs_sql('acc')}, {_GREEDY},
kept as (select doc_id as ord, ['lang:' || lang, 'source:' || source] as paths from acc where doc_id not in (select id from gone)),
{_trim_sql('kept', TARGET)} select ord as doc_id, cast(rank as bigint) as rank from trimmed"""
)
def accepted_final(spark, d):
    """Accepted rows, without near-duplicates, trimmed to the target for coverage."""
    docs = _documents(spark, d).join(table(spark, d, "labels").filter("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi")
    kept, _ = similarity.dedupe(docs, "doc_id", "text")
    rows = materialise(kept.select(F.col("doc_id").alias("ord"), F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("paths")))
    return coverage.trim(spark, rows, TARGET).withColumnRenamed("ord", "doc_id")


@_query(
    """with a as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as n from conversations where role = 'assistant'),
o as (select conv_id, min(n) filter (where n <= 2 and length(text) % 3 = 0) as first_accept, count(*) as critiques from a group by 1)
select conv_id, first_accept is not null as accepted, cast(coalesce(first_accept, least(critiques, 2)) as bigint) as critiques, cast(coalesce(first_accept - 1, least(critiques, 2)) as bigint) as refinements from o"""
)
def critic_loop_outcome(spark, d):
    """Assistant turns as critiques with one refinement allowed: the first that accepts ends the loop, and each other is followed by a refinement."""
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    each = turns.select("conv_id", n.alias("n"), (F.length("text") % 3 == 0).alias("accept"))
    first = F.min(F.when((F.col("n") <= 2) & F.col("accept"), F.col("n")))
    out = each.groupBy("conv_id").agg(first.alias("first"), F.least(F.count("*"), F.lit(2)).alias("most"))
    return out.select("conv_id", F.col("first").isNotNull().alias("accepted"), F.coalesce("first", "most").cast("long").alias("critiques"), F.coalesce(F.col("first") - 1, F.col("most")).cast("long").alias("refinements"))


@_query(
    f"""with {_pairs_sql('documents')}, {_GREEDY}, kept as (select * from documents where doc_id not in (select id from gone)),
{_grams_sql('kg', 'kept', 'doc_id', 13)}, {_grams_sql('rf', 'benchmark', 'item_id', 13)},
c as (select a.id, b.id as ref, count(*) as shared from kg a join rf b on a.g = b.g group by 1, 2),
bad as (select distinct c.id from c join kg_n x on x.id = c.id join rf_n y on y.id = c.ref where 5 * shared >= 4 * (x.n + y.n - shared)),
clean as (select * from kept where doc_id not in (select id from bad))
select 'count' as metric, cast((select count(*) from clean) as double) as value union all select 'dedupe.removed_count', (select count(*) from gone)
union all select 'decontamination.removed_count', (select count(*) from bad) union all select 'coverage.lang', (select count(distinct lang) from clean) / (select count(distinct lang) from documents)
union all select 'coverage.source', (select count(distinct source) from clean) / (select count(distinct source) from documents)"""
)
def evaluate_report(spark, d):
    """What is left after deduplication and decontamination, and what it covers."""
    docs = _documents(spark, d)
    clean, removed, bad = similarity.dedupe_decontaminate(docs, "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    clean = materialise(clean.select("lang", "source"))
    roots = spark.createDataFrame([("lang", ["lang"]), ("source", ["source"])], "factor string, path array<string>")
    paths = lambda rows: rows.select(F.explode(F.array(F.struct(F.lit("lang").alias("factor"), F.col("lang").alias("v")), F.struct(F.lit("source").alias("factor"), F.col("source").alias("v")))).alias("m")).filter("m.v is not null").select("m.factor", F.array(F.col("m.factor"), F.col("m.v")).alias("path"))
    tree = paths(docs).distinct().union(roots).withColumn("path_str", F.array_join("path", "/")).withColumn("level", F.size("path") - 1)
    covered = coverage.coverage(paths(clean), tree).filter("level = 1").select(F.concat(F.lit("coverage."), "factor").alias("metric"), (F.col("covered") / F.col("total")).alias("value"))
    count = lambda rows, name: rows.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    return count(clean, "count").union(count(removed, "dedupe.removed_count")).union(count(bad, "decontamination.removed_count")).union(covered)
