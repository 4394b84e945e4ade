"""Registered queries of the value-flow, tree and verification operators. Trees are JSON values made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names, templates
from factloom.operators import flows, joins, merges, trees, verify
from factloom.plans.catalog import local, query, read
from factloom.session import spread


def _text(column: str):
    return F.col(column).cast("string")


def _json(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _unit(name) -> object:
    """A descriptor of that name, as JSON."""
    return _json('{"Data":{"def":{"path":"', name, '","krate":{"name":"k"}}}}')


def _order_trees(spark, sf_dir):
    """Tuples of status and priority for finished orders, any of two for pending ones, a plain value for open ones."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    pair = lambda a, b: _json('{"Tuple":[', _unit(a), ",", _unit(b), "]}")
    own = pair(F.col("o_orderstatus"), F.col("o_orderpriority"))
    origin = F.when(F.col("o_orderstatus") == "F", own).when(F.col("o_orderstatus") == "P", _json('{"Any":[', own, ',{"All":[', pair(F.lit("x"), _text("o_custkey")), "]}]}")).otherwise(_unit(F.col("o_orderstatus")))
    return orders.select(F.col("o_orderkey").alias("root_id"), origin.alias("origin"))


@query("""
SELECT o_orderkey AS start, o_orderpriority AS element, NULL AS reason FROM orders WHERE o_orderstatus IN ('F', 'P') UNION ALL SELECT o_orderkey, o_custkey::VARCHAR, NULL FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, NULL, 'no tuple: Data' FROM orders WHERE o_orderstatus = 'O'""")
def tuple_projection(spark, sf_dir):
    values = _order_trees(spark, sf_dir)
    nodes = trees.flatten_origins(values)
    found, gaps = flows.tuple_element(values.select(F.col("root_id").alias("start"), "root_id"), nodes, 1)
    named = found.select("start", F.col("name").alias("element"))
    return named.withColumn("reason", F.lit(None).cast("string")).unionByName(gaps.select("start", F.lit(None).cast("string").alias("element"), "reason"))


@query("""
SELECT event_id AS start, CASE event_type WHEN 'error' THEN 'e' || user_id WHEN 'click' THEN 'm' || user_id END AS found, CASE event_type WHEN 'view' THEN 'side not recorded: Data' END AS reason FROM events WHERE event_type IN ('error', 'click', 'view')
UNION ALL SELECT event_id, 'both', NULL FROM events WHERE event_type = 'error'""")
def error_side(spark, sf_dir):
    """Errors are one of two `Err`s, clicks a mapped error, views unknown; purchases and signups are `Ok`."""
    kind = F.col("event_type")
    err = _json('{"Any":[{"Err":[', _unit(_json("e", _text("user_id"))), ']},{"Set":[{"Err":[', _unit(F.lit("both")), "]}]}]}")
    origin = F.when(kind == "error", err).when(kind == "click", _json('{"MapErr":[', _unit(_json("m", _text("user_id"))), "]}")).when(kind == "view", _unit(F.lit("v"))).otherwise(_json('{"Ok":[', _unit(F.lit("o")), "]}"))
    values = spread(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id").select(F.col("event_id").alias("root_id"), origin.alias("origin"))
    found, gaps = flows.error_side(values.select(F.col("root_id").alias("start"), "root_id"), trees.flatten_origins(values))
    nothing = F.lit(None).cast("string")
    return found.select("start", "found", nothing.alias("reason")).unionByName(gaps.select("start", nothing.alias("found"), "reason"))


@query("SELECT event_id AS start, event_type IN ('click', 'view') AS depends FROM events")
def input_dependence(spark, sf_dir):
    """Clicks and views hold an input deep inside."""
    leaf = F.when(F.col("event_type").isin("click", "view"), '{"Input":{"path":"argv"}}').otherwise('{"Unit":{"path":"none"}}')
    origin = _json('{"Any":[', _unit(F.col("event_type")), ',{"Tuple":[{"All":[', leaf, "]}]}]}")
    values = spread(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select(F.col("event_id").alias("root_id"), origin.alias("origin"))
    return flows.depends_on_input(values.select(F.col("root_id").alias("start"), "root_id"), trees.flatten_origins(values), ["Input"])


@query("""
SELECT c_custkey AS start, o_orderpriority AS value, o_orderstatus AS via, o_orderstatus <> 'P' AS live FROM customer JOIN (SELECT DISTINCT o_custkey % 25 AS s, o_orderpriority, o_orderstatus FROM orders) ON s = c_nationkey
UNION ALL SELECT c_custkey, n_name, 'initial', true FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, NULL, 'changes inside', false FROM customer WHERE c_nationkey % 5 = 0""")
def mutable_statics(spark, sf_dir):
    reads = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start"), F.col("c_nationkey").cast("long").alias("static"))
    initial = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("static"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 5 == 0).alias("interior"))
    stores = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("static"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("writer")).distinct()
    found, gaps = flows.static_values(reads, initial, stores, local(spark, [("F",), ("O",)], "writer string"))
    return found.unionByName(gaps.select("start", F.lit(None).cast("string").alias("value"), F.col("reason").alias("via"), F.lit(False).alias("live")))


@query("SELECT p_partkey AS root_id, CASE WHEN p_size < 25 THEN 'Adt' ELSE 'Param' END AS kind, CASE WHEN p_size < 25 THEN p_brand ELSE 'T' END AS name FROM part UNION ALL SELECT p_partkey, 'Adt', 'Box' FROM part")
def specialised_types(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    types = part.select(F.col("p_partkey").alias("root_id"), F.lit('{"Adt":{"path":"Box","krate":{"name":"k"},"args":[{"Param":"T"}]}}').alias("type"))
    nodes = trees.flatten_types(types)
    given = part.where("p_size < 25").select(F.col("p_partkey").alias("root_id"), F.lit("T").alias("param"), F.col("p_brand").alias("type"))
    return flows.specialised(nodes, given).select("root_id", "kind", "name")


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS static, l_partkey AS target FROM lineitem), d AS (SELECT p_partkey AS id FROM part WHERE p_size <> 13), f AS (SELECT static, target AS member FROM t JOIN d ON id = target),
n AS (SELECT static FROM f GROUP BY static HAVING count(*) > 1), odd AS (SELECT DISTINCT t.static FROM t JOIN n USING (static) WHERE target NOT IN (SELECT id FROM d))
SELECT static, member, NULL AS reason FROM f WHERE static NOT IN (SELECT static FROM odd) UNION ALL SELECT static, NULL, 'an element is no descriptor' FROM odd""")
def table_members(spark, sf_dir):
    """Orders are tables of parts; parts of size 13 are no descriptors. Orders' keys are negative, to tell them apart."""
    refers = read(spark, sf_dir, "lineitem").select((-1 - F.col("l_orderkey")).alias("static"), F.col("l_partkey").alias("target")).distinct()
    kinds = read(spark, sf_dir, "part").where("p_size <> 13").select(F.col("p_partkey").alias("id"))
    found, gaps = flows.table_members(refers, kinds)
    key = (-1 - F.col("static")).alias("static")
    return found.select(key, "member", F.lit(None).cast("string").alias("reason")).unionByName(gaps.select(key, F.lit(None).cast("long").alias("member"), "reason"))


@query("""
WITH f AS (SELECT o_custkey AS site, o_orderpriority AS variant, o_orderstatus = 'F' AS live FROM orders), k AS (SELECT c_custkey AS site, c_mktsegment AS family FROM customer WHERE c_nationkey < 12),
a(variant, family) AS (VALUES ('1-URGENT','BUILDING'),('2-HIGH','BUILDING'),('3-MEDIUM','MACHINERY'),('5-LOW','FURNITURE'),('1-URGENT','HOUSEHOLD')),
g AS (SELECT site, variant, bool_or(live) AS live FROM (SELECT site, variant, live FROM f JOIN k USING (site) JOIN a USING (variant, family) UNION ALL SELECT * FROM f WHERE site NOT IN (SELECT site FROM k)) GROUP BY ALL),
s AS (SELECT site, string_agg(CASE WHEN live THEN variant ELSE variant || ' (dead)' END, ',' ORDER BY variant) AS members, count(*) FILTER (live) AS n FROM g GROUP BY site),
u AS (SELECT c_custkey AS site, true AS l FROM customer WHERE c_acctbal < 0)
SELECT site, coalesce(members, '') AS members, coalesce(n, 0) AS n, coalesce(n, 0) = 0 OR (coalesce(l, false) AND coalesce(n, 0) < 5) AS unknown FROM s FULL JOIN u USING (site)""")
def boundary_members(spark, sf_dir):
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") == "F").alias("live"))
    customer = read(spark, sf_dir, "customer")
    families = customer.where("c_nationkey < 12").select(F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("family"))
    allowed = local(spark, [("1-URGENT", "BUILDING"), ("2-HIGH", "BUILDING"), ("3-MEDIUM", "MACHINERY"), ("5-LOW", "FURNITURE"), ("1-URGENT", "HOUSEHOLD")], "variant string, family string")
    unresolved = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("site"))
    return flows.boundary_members(found, unresolved, families, allowed, local(spark, [("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",), ("5-LOW",)], "variant string"))


@query("SELECT o_orderkey AS call, coalesce(n, o_orderstatus) AS name FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1) ON l_orderkey = o_orderkey")
def consumer_names(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_orderstatus").alias("name"))
    return flows.named_by_consumers(calls, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_returnflag").alias("name")))


@query("""
SELECT c_custkey, CASE WHEN g THEN CASE WHEN low THEN 'cut' ELSE '2-HIGH' END WHEN c_acctbal < 0 THEN 'debt' ELSE 'no rule' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, true AS g, bool_or(o_orderpriority = '5-LOW') AS low FROM orders WHERE o_orderpriority IN ('2-HIGH', '5-LOW') GROUP BY o_custkey) ON o_custkey = c_custkey
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def unknown_operations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    gaps = orders.where("o_orderpriority IN ('2-HIGH', '5-LOW')").select("c_custkey", F.when(F.col("o_orderpriority") == "5-LOW", "cut").otherwise(F.col("o_orderpriority")).alias("reason"))
    out = flows.unknown_operations(read(spark, sf_dir, "customer"), orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), gaps, ["c_custkey"], [("debt", F.col("c_acctbal") < 0), ("no rule", F.lit(True))])
    return out.select("c_custkey", "reason")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS symbol, 'known' AS asset FROM lineitem WHERE l_linestatus = 'F'), u AS (SELECT l_orderkey, l_linenumber, l_returnflag AS symbol, p_brand, p_size, l_quantity > 25 AS std FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O')
SELECT * FROM o UNION ALL SELECT l_orderkey, l_linenumber, symbol, CASE WHEN std AND p_brand < 'Brand#2' THEN p_brand WHEN p_brand < 'Brand#4' THEN 'unknown cipher' ELSE 'unknown' END FROM u WHERE (l_orderkey, l_linenumber, symbol) NOT IN (SELECT l_orderkey, l_linenumber, symbol FROM o)""")
def check_citations(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    place = ["l_orderkey", "l_linenumber"]
    occ = lines.where("l_linestatus = 'F'").select(*place, F.col("l_returnflag").alias("symbol"), F.lit("known").alias("asset")).distinct()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("callee"))
    uncovered = lines.where("l_linestatus = 'O'").join(part, "l_partkey").select(*place, F.col("l_returnflag").alias("symbol"), "callee", (F.col("l_quantity") > 25).alias("std_entry"))
    brands = part.select("callee").distinct()
    named = brands.select("callee", F.col("callee").alias("asset"), (F.col("callee") >= "Brand#2").alias("open"))
    return flows.cited_by_check(uncovered, named, brands.where("callee < 'Brand#4'").withColumn("primitive", F.lit("cipher")), occ, place)


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'member: fixed' WHEN 1 THEN 'member: caller, passed by `' || o_orderstatus || '`' WHEN 2 THEN 'member: dyn' || CASE WHEN o_totalprice > 100000 THEN '' ELSE ', possible' END
  ELSE 'member: static, possible (a value `' || o_orderstatus || '` puts in `' || o_orderpriority || '`)' END AS label FROM orders""")
def member_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "fixed").when(k == 1, "caller").when(k == 2, "dyn").otherwise("store")
    return read(spark, sf_dir, "orders").select("o_orderkey", flows.member_label(kind, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice") > 100000).alias("label"))


# --- trees


@query("SELECT o_orderkey AS root_id, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 6 ELSE 1 END AS size FROM orders")
def tree_sizes(spark, sf_dir):
    return trees.tree_size(trees.flatten_origins(_order_trees(spark, sf_dir)), 5)


@query("""
SELECT o_orderkey AS root_id, kind, count(*) AS n FROM (SELECT o_orderkey, unnest(CASE o_orderstatus WHEN 'F' THEN ['Tuple', 'Data', 'Data'] WHEN 'P' THEN ['Any', 'Truncated', 'Truncated'] ELSE ['Data'] END) AS kind FROM orders) GROUP BY ALL""")
def capped_trees(spark, sf_dir):
    return trees.cap_depth(trees.flatten_origins(_order_trees(spark, sf_dir)), 1).groupBy("root_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS root_id, unnest(CASE o_orderstatus WHEN 'F' THEN list_distinct([o_orderstatus, o_orderpriority]) WHEN 'P' THEN list_distinct([o_orderstatus, o_orderpriority, 'x', o_custkey::VARCHAR]) ELSE [o_orderstatus] END) AS found FROM orders")
def tree_descriptors(spark, sf_dir):
    return trees.descriptors(trees.flatten_origins(_order_trees(spark, sf_dir)))


@query("SELECT o_orderkey AS root_id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE o_orderstatus END AS owner FROM orders")
def owned_parameters(spark, sf_dir):
    origin = F.when(F.col("o_orderkey") % 2 == 0, '{"Param":{"index":0}}').otherwise(_json('{"Param":{"index":0,"owner":"', F.col("o_orderstatus"), '"}}'))
    nodes = trees.flatten_origins(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root_id"), origin.alias("origin")))
    return trees.own_params(nodes, "own").select("root_id", "owner")


@query("SELECT o_orderkey AS root_id, unnest(['Any', 'Data', 'Data']) AS kind, unnest([NULL, o_orderstatus, 's' || (o_custkey % 7)]) AS name FROM orders")
def substituted_trees(spark, sf_dir):
    """Parameter 0 of each order's value is the supplier tree of its customer's key modulo 7."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    origin = _json('{"Any":[', _unit(F.col("o_orderstatus")), ',{"Param":{"index":0}}]}')
    nodes = trees.flatten_origins(orders.select(F.col("o_orderkey").alias("root_id"), origin.alias("origin")))
    arguments = orders.select(F.col("o_orderkey").alias("root_id"), F.lit(0).cast("long").alias("ord"), (F.col("o_custkey") % 7).alias("arg_root"))
    graft = trees.flatten_origins(spark.range(7).select(F.col("id").alias("root_id"), _unit(_json("s", _text("id"))).alias("origin")))
    return trees.substitute(nodes, arguments, graft).select("root_id", "kind", F.when(F.col("kind") == "Data", F.col("name")).alias("name"))


def _part_types(spark, sf_dir):
    second, third = _json("B", (F.col("p_size") % 5).cast("string")), _json("C", (F.col("p_size") % 3).cast("string"))
    adt = lambda name, *args: _json('{"Adt":{"path":"x::', name, '","krate":{"name":"k"},"args":[', *args, "]}}")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("root_id"), adt(F.col("p_type"), adt(second), ",", adt(third)).alias("type"))


@query("SELECT p_partkey AS root_id, 'x::C' || p_size % 3 AS name FROM part")
def type_arguments(spark, sf_dir):
    return trees.type_argument(trees.flatten_types(_part_types(spark, sf_dir)), [1]).where("node_id = 0").select("root_id", "name")


@query("""
WITH e(name, ord) AS (VALUES ('PROMO', 1), ('B2', 2), ('C1', 3), ('STANDARD', 4), ('B4', 5)), w AS (SELECT p_partkey, [p_type, 'B' || p_size % 5, 'C' || p_size % 3] AS w FROM part)
SELECT p_partkey AS root_id, ord, NULL AS "outer" FROM w JOIN e ON name = w[1] UNION ALL SELECT p_partkey, e.ord, o.ord FROM (SELECT p_partkey, w[1] AS h, unnest(w[2:3]) AS t FROM w) JOIN e ON e.name = t LEFT JOIN e o ON o.name = h""")
def type_matches(spark, sf_dir):
    entries = local(spark, [("k", "PROMO", 1), ("k", "B2", 2), ("k", "C1", 3), ("k", "STANDARD", 4), ("k", "B4", 5)], "crate string, name string, ord int")
    return trees.match_types(trees.flatten_types(_part_types(spark, sf_dir)), entries).select("root_id", "ord", "outer")


@query("""
SELECT event_id AS start, CASE event_type WHEN 'purchase' THEN 'hard-coded' WHEN 'click' THEN 'random' WHEN 'view' THEN 'hard-coded' WHEN 'error' THEN 'computed' ELSE 'parameter' END AS classes FROM events""")
def provenance_classes(spark, sf_dir):
    """Purchases are constants, clicks random draws, views pass a constant on, errors are computed, signups parameters."""
    kind, const = F.col("event_type"), '{"Const":{"value":"7"}}'
    call = lambda name, args: '{"Call":{"callee":"' + name + '","krate":"k","args":[' + args + "]}}"
    origin = F.when(kind == "purchase", const).when(kind == "click", call("draw", "")).when(kind == "view", call("pass", const)).when(kind == "error", call("own", const)).otherwise('{"Param":{"index":0,"owner":"f"}}')
    values = read(spark, sf_dir, "events").select(F.col("event_id").alias("root_id"), origin.alias("origin"))
    passes = local(spark, [("pass",)], "callee string").withColumn("slots", F.array(F.lit(0).cast("long")))
    params = spark.createDataFrame([], "owner string, ord long, root_id long")
    out = trees.classify_provenance(values.select(F.col("root_id").alias("start"), "root_id"), trees.flatten_origins(values), local(spark, [("draw", "random")], "callee string, class string"), passes, params)
    return out.select("start", F.col(out.columns[1]).alias("classes"))


# --- verification and scalars


@query("SELECT doc_id, line, n_chars > 400 AND line <= 3 AS inside FROM (SELECT doc_id, n_chars, unnest([1, 3, 9]) AS line FROM documents)")
def inside_items(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(_text("doc_id").alias("path"), F.lit("f").alias("item"), "doc_id", "n_chars")
    lines = docs.select("path", "item", "doc_id", F.explode(F.array(*[F.lit(k) for k in (1, 3, 9)])).alias("line"))
    items = docs.where("n_chars > 400").select("path", "item", F.lit(1).alias("first"), F.lit(3).alias("last"))
    return verify.inside_item(lines, items).select("doc_id", "line", "inside")


@query("SELECT 'nation' || n_regionkey AS path, n_name AS name, n_nationkey || '.0' AS version FROM nation")
def lock_entries(spark, sf_dir):
    """A lock file a region, an entry a nation."""
    nation = read(spark, sf_dir, "nation")
    row = lambda k, code: nation.select(_json("nation", _text("n_regionkey")).alias("path"), (F.col("n_nationkey").cast("long") * 4 + k).alias("line"), code.alias("code"))
    lines = row(0, F.lit("[[package]]")).union(row(1, _json('name = "', F.col("n_name"), '"'))).union(row(2, _json('version = "', _text("n_nationkey"), '.0"')))
    return verify.lock_entries(lines).select("path", "name", "version")


@query("SELECT l_linenumber, CASE WHEN l_linenumber > 5 THEN 'no such line' WHEN l_linenumber = 5 THEN 'beyond the line' WHEN l_linenumber = 4 THEN 'another token' ELSE 'ok' END AS verdict, count(*) AS n FROM lineitem GROUP BY ALL")
def verified_positions(spark, sf_dir):
    """Lines 1 to 5 of each file hold `a seal(x)`."""
    n = F.col("l_linenumber")
    cited = read(spark, sf_dir, "lineitem").select("l_linenumber", F.lit("f").alias("path"), n.cast("long").alias("line"), F.when(n == 5, 99).when(n == 4, 3).otherwise(2).alias("offset"), F.lit("x::seal").alias("symbol"))
    lines = local(spark, [("f", k, "a seal(x)") for k in range(1, 6)], "path string, line bigint, code string")
    return verify.verify_positions(cited, lines).groupBy("l_linenumber", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'runtime' WHEN c_acctbal < 0 THEN 'dead' ELSE 'gap' END AS class FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')) GROUP BY class")
def linked_not_walked(spark, sf_dir):
    symbols = read(spark, sf_dir, "customer").withColumn("symbol", F.col("c_custkey"))
    walked = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("symbol"))
    return verify.linked_not_walked(symbols, walked, [("runtime", F.col("c_mktsegment") == "MACHINERY"), ("dead", F.col("c_acctbal") < 0)])


@query("SELECT n_name AS line, '-' AS sign FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_name, '+' FROM nation WHERE n_nationkey > 20")
def golden_lines(spark, sf_dir):
    some = lambda c: read(spark, sf_dir, "nation").where(c).select(F.col("n_name").alias("line"))
    return verify.golden(some("n_nationkey > 2"), some("n_nationkey < 21"))


@query("SELECT doc_id, line, CASE WHEN line <= len(string_split(text, chr(10))) THEN string_split(text, chr(10))[line] END AS code FROM (SELECT doc_id, text, unnest([1, 2, 50]) AS line FROM documents)")
def review_sheet(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", _text("doc_id").alias("path"), "text")
    labels = docs.select("doc_id", "path", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 50)])).alias("line"))
    return verify.review_sheet(labels, verify.source_lines(docs)).select("doc_id", "line", "code")


@query("SELECT l_partkey, min(lo) = 0 AND max(hi) >= 100 AND bool_and(lo <= b) AS covered FROM (SELECT l_partkey, lo, hi, coalesce(max(hi) OVER (PARTITION BY l_partkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT l_partkey, (l_suppkey * 37 + l_orderkey) % 100 AS lo, (l_suppkey * 37 + l_orderkey) % 100 + 20 AS hi FROM lineitem)) GROUP BY l_partkey")
def covered_ranges(spark, sf_dir):
    lo = (F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 100
    return merges.interval_cover(read(spark, sf_dir, "lineitem").select("l_partkey", lo.alias("lo"), (lo + 20).alias("hi"), F.lit(100).alias("n")), ["l_partkey"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || '||' || p_type ELSE p_brand || '|' || p_name || '|' END AS key, 'a::f' || p_size AS fn, p_size % 8 AS number, p_brand IN ('Brand#11', 'Brand#12') AS named FROM part""")
def name_scalars(spark, sf_dir):
    size = F.col("p_size")
    bits = F.array(*[(F.shiftright(size, k) % 2) for k in (2, 1, 0)])
    key = names.asset_key(F.col("p_brand"), F.col("p_name"), F.when(size % 3 == 0, F.col("p_type")))
    package = F.concat(F.lit("rust-"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("-x"))
    path = _json("a::f", _text("p_size"), "::{closure#0}::{closure#1}")
    return read(spark, sf_dir, "part").select("p_partkey", key.alias("key"), names.enclosing_function(path).alias("fn"), names.typenum_value(bits).alias("number"), names.names_algorithm(package, ["brand11", "brand12"]).alias("named"))


@query("SELECT p_partkey, p_size % 3 <> 1 AS valid FROM part")
def registry_names(spark, sf_dir):
    grammar = templates.NameGrammar(["SHA-(224|256)", "HMAC[-{algorithm}][-{number}]"], [])
    valid = F.udf(grammar.valid, "boolean") if not hasattr(grammar, "column") else grammar.column
    name = F.when(F.col("p_size") % 3 == 0, "SHA-256").when(F.col("p_size") % 3 == 1, "SHA-1").otherwise(_json("HMAC-SHA-224-", _text("p_size")))
    distinct = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    told = distinct.select("name").distinct().withColumn("valid", valid("name"))
    return distinct.join(told, "name").select("p_partkey", "valid")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) - 1 AS ord FROM nation")
def facts_order(spark, sf_dir):
    """Ordinals in the facts' order, by a sort of the whole and one number a row."""
    from factloom.operators.merges import numbered

    return numbered(read(spark, sf_dir, "nation"), ["n_regionkey", "n_name", "n_nationkey"]).select("n_nationkey", "ord")


@query("""
SELECT o_orderkey, c_custkey AS fn, c.o_custkey IS NULL AS open FROM orders LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') c USING (o_custkey)
JOIN customer ON CASE WHEN c.o_custkey IS NOT NULL THEN c_custkey = orders.o_custkey ELSE c_nationkey = orders.o_custkey % 25 AND (c_mktsegment = 'BUILDING') END WHERE o_orderstatus = 'P'""")
def pointer_calls(spark, sf_dir):
    """Pending orders call: urgent customers are named; the others are open to all of the nation and segment."""
    orders = read(spark, sf_dir, "orders")
    calls = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % 25).cast("int").alias("arity"), F.lit("BUILDING").alias("sig"), "o_custkey")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    named = calls.join(urgent, "o_custkey").select("call", F.col("o_custkey").alias("function"))
    functions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("function"), F.col("c_nationkey").alias("arity"), F.col("c_mktsegment").alias("sig"))
    return joins.pointer_targets(calls.drop("o_custkey"), named, functions).select(F.col("call").alias("o_orderkey"), F.col("function").alias("fn"), "open")
