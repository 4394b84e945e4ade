"""More registered queries: knowledge lookups, evidence, walks and solvers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import templates
from factloom.operators import evidence, graph, joins, knowledge, merges, pointsto
from factloom.plans.catalog import HALVING, halving, local, query, read


@query("SELECT n_nationkey, n_name, c_custkey FROM nation JOIN (SELECT c_custkey, 'NATION_' || c_nationkey AS nm, c_nationkey % 5 AS rk FROM customer) ON n_name = nm AND n_regionkey = rk")
def by_name_and_version(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("n_name"), (F.col("c_nationkey") % 5).alias("n_regionkey"))
    return knowledge.by_name_and_version(rows, read(spark, sf_dir, "nation"), "n_name", "n_regionkey").select("n_nationkey", "n_name", "c_custkey")


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def keyed_index(spark, sf_dir):
    return knowledge.keyed_index(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"])


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def call_site_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    place = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return knowledge.at_call_site(lines.select(*place), lines.select(*place, "l_quantity"), place).select("l_orderkey", "l_linenumber", "l_quantity")


LISTED = "(VALUES (1,'seal',['PROMO','SMALL'],'(?i)^p'),(2,'hash',['PROMO','ECONOMY','LARGE'],'(?i)E'),(3,'sign',['STANDARD'],'.'),(4,'other',['ECONOMY','MEDIUM','LARGE','SMALL','PROMO'],'.')) r(ord, operation, crates, pattern)"


@query(f"""
SELECT p_partkey, operation, ord FROM (SELECT p_partkey, operation, ord, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS k
FROM part LEFT JOIN {LISTED} ON list_contains(crates, split_part(p_type, ' ', 1)) AND regexp_matches(p_type, pattern)) WHERE k = 1""")
def operation_match(spark, sf_dir):
    entries = spark.sql("SELECT * FROM VALUES (1,'seal',array('PROMO','SMALL'),'(?i)^p'),(2,'hash',array('PROMO','ECONOMY','LARGE'),'(?i)E'),(3,'sign',array('STANDARD'),'.'),(4,'other',array('ECONOMY','MEDIUM','LARGE','SMALL','PROMO'),'.') AS t(ord, operation, crates, pattern)")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", F.substring_index("p_type", " ", 1).alias("crate"))
    return knowledge.in_listed_crates(part, entries, ["p_partkey"], "crate", "p_type", how="left").select("p_partkey", "operation", "ord")


@query("""
SELECT ord, r_name AS name, versions FROM (VALUES (1,'AFRICA',2),(2,'ASIA',NULL),(3,'EUROPE',0),(4,'NOWHERE',1),(5,'AMERICA',100)) e(ord, r_name, versions)
WHERE versions IS NULL OR (SELECT bool_and(n_nationkey >= versions) FROM nation JOIN region USING (r_name) WHERE n_regionkey = r_regionkey AND region.r_name = e.r_name)""".replace("JOIN region USING (r_name) WHERE n_regionkey = r_regionkey AND", "JOIN region ON n_regionkey = r_regionkey WHERE"))
def entry_applies(spark, sf_dir):
    entries = local(spark, [(1, "AFRICA", 2), (2, "ASIA", None), (3, "EUROPE", 0), (4, "NOWHERE", 1), (5, "AMERICA", 100)], "ord int, name string, versions int")
    crates = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_nationkey").alias("version"))
    return knowledge.entries_that_apply(entries, crates, F.col("version") >= F.col("versions"))


@query("""
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)
AND (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_mktsegment IN ('BUILDING', 'FURNITURE'))""")
def opaque_types(spark, sf_dir):
    types = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    own = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    unmodelled = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    roles = local(spark, [("BUILDING", "algorithm"), ("FURNITURE", "protocol"), ("MACHINERY", "trait")], "c_mktsegment string, role string")
    return knowledge.opaque_types(types, own, unmodelled, roles, ["c_nationkey"], "c_mktsegment")


@query("""
SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'crypto' WHEN NOT (p_size % 4 = 1 OR p_size % 7 = 2 OR (p_size % 4 = 0 AND p_partkey % 5 = 0)) THEN NULL
  WHEN p_brand = 'Brand#12' OR p_size % 4 = 2 THEN 'support' ELSE 'crypto' END AS class FROM part""")
def unmodelled_packages(spark, sf_dir):
    """Categories by size mod 4 (0: none), keywords by size mod 7, names by key mod 5."""
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    kind, word = F.col("p_size") % 4, F.col("p_size") % 7
    categories = F.when(kind == 1, texts("Cryptography")).when(kind == 2, texts("Encoding")).when(kind == 3, texts("web"))
    keywords = F.when(word == 2, texts("fast", "X509")).otherwise(texts("fast"))
    return read(spark, sf_dir, "part").select("p_partkey", knowledge.unmodelled_class(F.col("p_brand"), categories, keywords, ["Brand#11"], ["Brand#12"], F.col("p_partkey") % 5 == 0).alias("class"))


@query("""
SELECT o_orderkey, string_agg(function, ' or ' ORDER BY ord) AS use FROM orders LEFT JOIN (VALUES ('F','1-URGENT','encrypt',1),('F',NULL,'decrypt',2),('O',NULL,'digest',3),('O','5-LOW','sign',4),('F','2-HIGH','wrap',5)) u(m, p, function, ord)
ON o_orderstatus = m AND (p IS NULL OR p = o_orderpriority) GROUP BY o_orderkey""")
def method_uses(spark, sf_dir):
    uses = local(spark, [("F", "1-URGENT", "encrypt", 1), ("F", None, "decrypt", 2), ("O", None, "digest", 3), ("O", "5-LOW", "sign", 4), ("F", "2-HIGH", "wrap", 5)], "method string, primitive string, function string, ord int")
    calls = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("primitive"))
    return knowledge.uses_of(calls, uses, ["o_orderkey"]).select("o_orderkey", "use")


@query("""
WITH c AS (SELECT p_partkey, 'core::' || p_type || '::' || p_size % 5 || '::' || p_size % 3 AS path FROM part), t(suffix, class) AS (VALUES ('1','Arg'),('4::1','Store'),('PROMO::3::2','Map'),('0','Choice'),('ARD::2::2','Old'),('2::2','Nothing'))
SELECT p_partkey, (SELECT class FROM t WHERE path = suffix OR ends_with(path, '::' || suffix) ORDER BY length(suffix) DESC LIMIT 1) AS class FROM c""")
def standard_semantics(spark, sf_dir):
    calls = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("::", F.lit("core"), "p_type", (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 3).cast("string")).alias("path"))
    table = local(spark, [("1", "Arg"), ("4::1", "Store"), ("PROMO::3::2", "Map"), ("0", "Choice"), ("ARD::2::2", "Old"), ("2::2", "Nothing")], "suffix string, class string")
    return knowledge.suffix_lookup(calls, table, "path").select("p_partkey", "class")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ring' WHEN 'O' THEN 'aws' ELSE 'default' END AS package FROM orders""")
def backend_default(spark, sf_dir):
    paths = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("::", F.lit("crypto"), "o_orderstatus", F.lit("seal")).alias("path"))
    return knowledge.with_default_by_text(paths, local(spark, [("F", "ring"), ("O", "aws"), ("seal", "no")], "feature string, package string"), "path", "feature", "package", F.lit("default")).select("o_orderkey", "package")


@query(f"""
WITH RECURSIVE {HALVING}, w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b), g AS (SELECT p_partkey FROM part WHERE p_size = 7)
SELECT p_partkey AS type FROM part WHERE p_size = 7 OR p_partkey IN (SELECT a FROM w WHERE b IN (SELECT p_partkey FROM g))""")
def carriers(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    fields = halving(spark, sf_dir).toDF("type", "field_type")
    return knowledge.carriers(part.select(F.col("p_partkey").alias("type")), fields, part.where("p_size = 7").select(F.col("p_partkey").alias("type")))


@query("""
SELECT o_orderkey, s_suppkey, 'receiver' AS route FROM orders JOIN supplier ON s_nationkey = o_custkey % 25 AND s_suppkey % 3 = o_orderkey % 3 WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, s_suppkey, 'any implementation' FROM orders JOIN supplier ON s_nationkey = o_custkey % 25 WHERE o_orderstatus = 'P'""")
def implementations(spark, sf_dir):
    calls = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("callee"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 3).alias("self_type"))
    bodies = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("callee"), (F.col("s_suppkey") % 3).alias("self_type"), "s_suppkey")
    return knowledge.implementations(calls, bodies).select("o_orderkey", "s_suppkey", "route")


@query("""
SELECT l_orderkey, l_linenumber, t.type FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT s_suppkey, unnest(CASE WHEN s_nationkey % 3 = 0 THEN ['A', 'B'] ELSE ['A'] END) AS type FROM supplier WHERE s_nationkey % 4 > 0) t ON s_suppkey = l_suppkey""")
def bound_parameters(spark, sf_dir):
    sites = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("function"), F.lit("T").alias("param"))
    types = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    given = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("function"), F.lit("T").alias("param"), types.alias("types"), (F.col("s_nationkey") % 4 == 0).alias("open"))
    return knowledge.bound_sites(sites, given).select("l_orderkey", "l_linenumber", "type")


@query("""
SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size % 4 = 0 THEN 'HMAC' ELSE 'HMAC-' || p_size * 8 END AS part, p_size % 4 = 0 AS open FROM part WHERE p_brand = 'Brand#11'
UNION SELECT p_partkey::VARCHAR, 'SHA-512', false FROM part WHERE p_partkey = 7""")
def parts_of_assets(spark, sf_dir):
    values = F.when(F.col("p_size") % 4 != 0, F.create_map(F.lit("len"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    outer = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("family"), values.alias("values"))
    parts = local(spark, [("Brand#11", "HMAC-{bits}", "bits", "len", 8), ("7", "SHA-512", "none", "none", None)], "of string, template string, param string, source string, scale int")
    return knowledge.parts_of(outer, parts)


@query("SELECT p_partkey, p_brand FROM part WHERE (p_size % 3 > 0 OR p_brand <> 'Brand#11') AND (p_size % 5 > 0 OR p_brand <> 'Brand#12')")
def required_parameters(spark, sf_dir):
    need = F.when(F.col("p_brand") == "Brand#11", F.array(F.lit("bits"))).when(F.col("p_brand") == "Brand#12", F.array(F.lit("curve"))).otherwise(F.array().cast("array<string>"))
    part = read(spark, sf_dir, "part")
    bits = part.select("p_partkey", F.lit("bits").alias("param"), F.when(F.col("p_size") % 3 > 0, "x").alias("value"))
    curve = part.select("p_partkey", F.lit("curve").alias("param"), F.when(F.col("p_size") % 5 > 0, "y").alias("value"))
    return knowledge.required_parameters(part.select("p_partkey", "p_brand", need.alias("required")), bits.union(curve), ["p_partkey"]).select("p_partkey", "p_brand")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN (l_partkey * 8)::VARCHAR END WHEN l_linenumber = 2 THEN l_suppkey::VARCHAR WHEN l_linenumber = 3 THEN NULL ELSE 'fixed' END AS v FROM lineitem""")
def call_values(spark, sf_dir):
    n, none = F.col("l_linenumber"), F.lit(None).cast("int")
    consts = F.array(F.lit(0).cast("long"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")))
    value = knowledge.call_value(consts, F.array("l_suppkey"), F.when(n == 1, 1).otherwise(none), F.lit(8), F.when(n == 2, 0).when(n == 3, 5).otherwise(none), F.lit("fixed"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("v"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'AES-' || p_size || '-GCM' ELSE 'AES-GCM' END AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'key' END AS open, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS size FROM part""")
def filled_record(spark, sf_dir):
    """An algorithm record: its name, size and open placeholders; those of optional parts are not open."""
    values = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("key"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    usual = F.create_map(F.lit("tag"), F.lit("128"))
    template, size = F.lit("AES-{key}-GCM[-{tag}]"), F.lit("{key}")
    filled = [templates.fill_template(template, values, usual).alias("name"), F.array_join(knowledge.open_placeholders(template, values), ",").alias("open"), F.nullif(templates.fill_template(size, values, usual), F.lit("")).alias("size")]
    return read(spark, sf_dir, "part").select("p_partkey", *filled)


@query("""
SELECT o_orderkey AS root_id, CASE WHEN l_partkey % 3 = 0 THEN 'mapped' ELSE (l_partkey * 8)::VARCHAR END AS value FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def tree_parameter(spark, sf_dir):
    """Orders are roots, their first lines slot 1 of slot 0."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    row = lambda df, i, up, name, slot: df.select(F.col(df.columns[0]).alias("root_id"), F.lit(i).alias("node_id"), F.lit(up).cast("int").alias("parent_id"), name.cast("string").alias("name"), F.lit(slot).alias("slot"))
    nodes = row(orders, 0, None, F.lit("root"), 0).unionByName(row(orders, 1, 0, F.lit("mid"), 0)).unionByName(row(lines, 2, 1, F.col("p"), 1))
    mapping = lines.where("p % 3 = 0").select(F.col("p").cast("string").alias("name"), F.lit("mapped").alias("value")).distinct()
    return knowledge.tree_parameter(nodes, [0, 1], mapping, 8)


PLACES = "CASE c_custkey % 4 WHEN 0 THEN '/ws/target/out/' || c_custkey WHEN 1 THEN '/ws/dep' || c_nationkey || '/src/' || c_custkey WHEN 2 THEN '/ws/own/src/' || c_custkey ELSE '/else/' || c_custkey END"


def _places(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    which = F.col("c_custkey") % 4
    path = F.when(which == 0, F.concat(F.lit("/ws/target/out/"), key)).when(which == 1, F.concat(F.lit("/ws/dep"), nation, F.lit("/src/"), key)).when(which == 2, F.concat(F.lit("/ws/own/src/"), key)).otherwise(F.concat(F.lit("/else/"), key))
    packages = read(spark, sf_dir, "nation").select(F.concat(F.lit("/ws/dep"), F.col("n_nationkey").cast("string")).alias("dir"), F.lower("n_name").alias("name"), F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")).alias("version"), F.lit(False).alias("member"))
    own = local(spark, [("/ws/own", "own", "1.0", True)], "dir string, name string, version string, member boolean")
    return read(spark, sf_dir, "customer").select("c_custkey", path.alias("path")), packages.unionByName(own)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'target/out/' || c_custkey WHEN 1 THEN lower(n_name) || '-' || n_regionkey || '.0/src/' || c_custkey WHEN 2 THEN 'own/src/' || c_custkey ELSE '/else/' || c_custkey END AS location FROM customer JOIN nation ON n_nationkey = c_nationkey")
def location_names(spark, sf_dir):
    paths, packages = _places(spark, sf_dir)
    return knowledge.location(paths, packages, "path", "/ws", "/ws/target").select("c_custkey", "location")


@query(f"SELECT c_custkey, {PLACES} AS path FROM customer")
def location_inverse(spark, sf_dir):
    paths, packages = _places(spark, sf_dir)
    named = knowledge.location(paths, packages, "path", "/ws", "/ws/target").select("c_custkey", "location")
    return knowledge.resolved_location(named, packages, "location", "/ws", "/ws/target").select("c_custkey", "path")


# --- evidence


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#13')")
def implementation_sites(spark, sf_dir):
    roles = local(spark, [("Brand#11", "algorithm"), ("Brand#12", "protocol"), ("Brand#13", "trait")], "p_brand string, role string")
    return evidence.not_implementations(read(spark, sf_dir, "part"), roles, "p_brand").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def accounted_namings(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return evidence.unaccounted(read(spark, sf_dir, "part").select("p_partkey"), used, ["p_partkey"])


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'caller' WHEN 1 THEN 'static' WHEN 2 THEN 'store' ELSE 'fixed' END AS kind, o_custkey::VARCHAR AS w, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS s FROM orders),
x AS (SELECT *, w IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0) AS p, coalesce(s IN ('F'), false) AS i FROM r)
SELECT o_orderkey, CASE WHEN kind IN ('caller', 'static') THEN CASE WHEN s IS NOT NULL THEN i ELSE p END WHEN kind = 'store' THEN p AND (s IS NULL OR i) ELSE true END AS live FROM x""")
def live_routes(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "caller").when(k == 1, "static").when(k == 2, "store").otherwise("fixed")
    routes = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.col("o_custkey").cast("string").alias("writer"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("static_id"))
    paths = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"))
    return evidence.live(routes, local(spark, [("F",)], "id string"), paths).select("o_orderkey", "live")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07 AND l_linenumber = 7)")
def candidate_assets(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_tax > 0.07 AND l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    return evidence.candidates(read(spark, sf_dir, "supplier").select("s_suppkey"), found, ["s_suppkey"])


@query("""
WITH p AS (SELECT o_orderkey, l_linenumber, l_shipinstruct FROM (SELECT o_orderkey, o_orderstatus FROM orders) JOIN (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipinstruct FROM lineitem) ON l_orderkey = o_orderkey),
n AS (SELECT p.*, contains(l_shipinstruct, o_orderstatus) AS named FROM p JOIN orders USING (o_orderkey)),
a AS (SELECT *, bool_or(named) OVER (PARTITION BY o_orderkey) AS any_named FROM n)
SELECT o_orderkey, l_linenumber FROM a WHERE NOT any_named OR named""")
def label_occurrences(spark, sf_dir):
    labels = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), "o_orderkey", F.col("o_orderstatus").alias("callee"))
    occ = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("symbol"))
    return evidence.site_occurrences(labels, occ, ["o_orderkey"], ("file",)).select("o_orderkey", "l_linenumber")


@query("""
WITH e AS (SELECT l_suppkey, l_returnflag = 'R' AS r, unnest(string_split(l_returnflag || ' or ' || l_linestatus, ' or ')) AS f FROM lineitem)
SELECT l_suppkey, coalesce(string_agg(DISTINCT CASE WHEN r THEN f END, ',' ORDER BY CASE WHEN r THEN f END), string_agg(DISTINCT f, ',' ORDER BY f)) AS observed FROM e GROUP BY l_suppkey""")
def observed_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", F.lit(" or "), "l_linestatus").alias("functions"), (F.col("l_returnflag") == "R").alias("reachable"))
    return evidence.observed_functions(rows, ["l_suppkey"])


@query("""
WITH o AS (SELECT DISTINCT p_brand AS asset, CASE WHEN p_size % 3 = 0 THEN 'instantiation' ELSE 'call' END AS kind, p_type AS location, p_size AS line, p_partkey % 4 AS "offset" FROM part),
led AS (SELECT DISTINCT p_brand AS "to", p_type AS location, p_size AS line, (p_partkey + 1) % 4 AS "offset" FROM part),
i AS (SELECT o.*, led."to" FROM o JOIN led USING (location, line, "offset") WHERE kind = 'instantiation'),
stay AS (SELECT DISTINCT asset, location, line, "offset" FROM i WHERE asset = "to" OR ("to" = 'Brand#21' AND asset = 'Brand#11')),
mv AS (SELECT i.* FROM i WHERE (asset, location, line, "offset") NOT IN (SELECT * FROM stay) AND substr(asset, 7, 1) = substr("to", 7, 1)),
kept AS (SELECT * FROM o WHERE NOT (kind = 'instantiation' AND (asset, location, line, "offset") IN (SELECT asset, location, line, "offset" FROM mv)))
SELECT * FROM kept UNION ALL SELECT * FROM (SELECT DISTINCT "to", 'instantiation', location, line, "offset" FROM mv) m(asset, kind, location, line, "offset") WHERE (asset, location, line, "offset") NOT IN (SELECT asset, location, line, "offset" FROM kept)""")
def reattributed_instances(spark, sf_dir):
    """Brands of one first digit are one cipher in several modes; Brand#21 holds Brand#11."""
    part = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "instantiation").otherwise("call")
    place = lambda shift: [F.col("p_type").alias("location"), F.col("p_size").alias("line"), ((F.col("p_partkey") + shift) % 4).alias("offset")]
    occ = part.select(F.col("p_brand").alias("asset"), kind.alias("kind"), *place(0)).distinct()
    leads = part.select(F.col("p_brand").alias("asset"), *place(1)).distinct()
    brands = part.select(F.col("p_brand").alias("asset"), F.substring("p_brand", 7, 1).alias("d")).distinct()
    same = brands.join(brands.select(F.col("asset").alias("mode_asset"), "d"), "d").where("asset <> mode_asset").select("asset", "mode_asset")
    return evidence.instantiated_in_a_mode(occ, leads, same, local(spark, [("Brand#21", "Brand#11")], "asset string, part string"))


@query("""
WITH r AS (SELECT DISTINCT l_linestatus = 'O' AS known, CASE WHEN l_returnflag = 'R' THEN 'call' ELSE 'type' END AS kind, l_returnflag AS symbol, l_tax > 0.04 AS generic_body, l_partkey AS location, l_linenumber AS line, l_suppkey % 5 AS "offset" FROM lineitem),
k AS (SELECT DISTINCT location, line, "offset", symbol FROM r WHERE known AND kind = 'call')
SELECT * FROM r WHERE known OR (NOT (generic_body AND (location, line, "offset", symbol) IN (SELECT * FROM k)) AND (location // 2, line, "offset") NOT IN (SELECT location, line, "offset" FROM k))""")
def answered_unknowns(spark, sf_dir):
    """What stands at a part was made through the half of its key."""
    lines = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "call").otherwise("type")
    rows = lines.select((F.col("l_linestatus") == "O").alias("known"), kind.alias("kind"), F.col("l_returnflag").alias("symbol"), (F.col("l_tax") > 0.04).alias("generic_body"), F.col("l_partkey").alias("location"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 5).alias("offset")).distinct()
    through = rows.select("location", "line", "offset", F.expr("location div 2").alias("outer_location"), F.col("line").alias("outer_line"), F.col("offset").alias("outer_offset")).distinct()
    return evidence.without_answered_unknowns(rows, through)


@query("""
SELECT l_suppkey, bool_or(f) AS f, string_agg(DISTINCT s, ',' ORDER BY s) AS s FROM (SELECT l_suppkey, l_quantity > 45 AS f, l_returnflag AS s FROM lineitem UNION ALL SELECT s_suppkey, s_acctbal < 0, 'S' FROM supplier) GROUP BY l_suppkey""")
def merged_links(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 45).alias("f"), F.array("l_returnflag").alias("s"))
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("f"), F.array(F.lit("S")).alias("s"))
    return evidence.merged_links(lines, own, key=["l_suppkey"], flags=["f"], sets=["s"]).withColumn("s", F.array_join("s", ","))


@query("""
WITH r AS (SELECT o_custkey, o_orderpriority AS role, CASE WHEN o_totalprice > 300000 THEN 'hard-coded' ELSE o_orderstatus END AS kind, o_orderstatus = 'F' AS reachable FROM orders)
SELECT o_custkey, role, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN bool_or(kind = 'hard-coded' AND reachable) THEN 'finding' WHEN bool_or(kind = 'hard-coded') THEN 'present' END AS finding FROM r GROUP BY o_custkey, role""")
def findings_by_role(spark, sf_dir):
    kind = F.when(F.col("o_totalprice") > 300000, "hard-coded").otherwise(F.col("o_orderstatus"))
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("role"), kind.alias("kind"), (F.col("o_orderstatus") == "F").alias("reachable"))
    return evidence.findings(rows, ["o_custkey"])


@query("SELECT o_orderstatus AS verdict, o_orderpriority AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 3) AS share FROM orders GROUP BY 1, 2")
def excuse_counts(spark, sf_dir):
    return evidence.excuse_counts(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("reason")))


@query("""
WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'support' ELSE 'crypto' END AS side FROM customer WHERE c_acctbal > 0),
r AS (SELECT DISTINCT o_custkey AS k, CASE WHEN o_custkey % 10 = 0 THEN 'support' ELSE 'crypto' END AS side FROM orders WHERE o_orderstatus = 'P')
SELECT side, count(l.k) AS labelled, count(r.k) AS reported, count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL) AS found, count(*) FILTER (r.k IS NULL) AS missed, count(*) FILTER (l.k IS NULL) AS extra FROM l FULL JOIN r USING (k, side) GROUP BY side""")
def package_score(spark, sf_dir):
    kind = lambda n: F.when(F.col("k") % n == 0, "support").otherwise("crypto").alias("kind")
    labelled = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).select("k", kind(5))
    reported = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct().select("k", kind(10))
    return evidence.package_score(labelled, reported, ["k"])


@query("SELECT CASE WHEN verdict = 'correct' AND f THEN 'function mismatch' ELSE verdict END AS verdict, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'correct' WHEN o_orderstatus = 'O' THEN 'wrong' ELSE 'miss' END AS verdict, o_orderpriority = '5-LOW' AS f FROM orders) GROUP BY 1")
def verdict_histogram(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "wrong").otherwise("miss")
    return evidence.verdict_histogram(read(spark, sf_dir, "orders").select(verdict.alias("verdict"), (F.col("o_orderpriority") == "5-LOW").alias("function_differs")))


@query("SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS provides, count(DISTINCT p_brand) AS n_assets FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
def provider_collection(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return evidence.providers(uses, "l_suppkey", "p_brand")


@query("SELECT l_partkey, l_quantity, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def strongest_at_place(spark, sf_dir):
    return evidence.strongest_at(read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber"), ["l_partkey"], "l_quantity", ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_edges(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


@query("""
SELECT o_custkey, is_join, rank, route FROM (SELECT o_custkey, o_orderstatus = 'O' AS is_join, o_orderkey % 7 AS rank, o_orderpriority AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderkey % 7, o_orderpriority) AS k FROM orders) WHERE k = 1""")
def best_routes(spark, sf_dir):
    values = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "O").alias("j"), (F.col("o_orderkey") % 7).alias("n"), F.col("o_orderpriority").alias("v"))
    return evidence.best_route(values, ["o_custkey"], "j", "n", "v")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_assets FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1 AND bool_or(l_returnflag = 'N')")
def exact_among_several(spark, sf_dir):
    return evidence.exact_among_several(read(spark, sf_dir, "lineitem").withColumn("asset", F.col("l_suppkey")), ["l_orderkey"], F.col("l_returnflag") == "N")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersected(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey").intersect(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


# --- walks and solvers


@query(f"""
WITH RECURSIVE {HALVING}, w(node, round) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 50 UNION SELECT e.b, w.round + 1 FROM w JOIN e ON e.a = w.node), f AS (SELECT node, min(round) AS round FROM w GROUP BY node)
SELECT round, count(*) AS n FROM f GROUP BY round""")
def walk_rounds(spark, sf_dir):
    """A walk far from its bound: nodes by round."""
    roots = read(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    walked, cut_off = graph.bounded_walk(roots, halving(spark, sf_dir), 2_000_000)
    return walked.groupBy("round").agg(F.count(F.lit(1)).alias("n")).where(F.lit(not cut_off))


@query("SELECT c_custkey, CASE WHEN c_custkey % 97 = 1 THEN 'entry' WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 'report' WHEN c_nationkey = 3 THEN 'linked' WHEN c_acctbal > 5000 THEN 'public' END AS reason FROM customer WHERE c_custkey % 97 = 1 OR (c_mktsegment = 'MACHINERY' AND c_acctbal < 0) OR c_nationkey = 3 OR c_acctbal > 5000")
def walk_roots(spark, sf_dir):
    flags = {"is_main": F.col("c_custkey") % 97 == 1, "is_report": (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 0), "is_exported": F.col("c_nationkey") == 3, "is_public": F.col("c_acctbal") > 5000}
    return graph.roots_of(read(spark, sf_dir, "customer").withColumns(flags), is_library=True).select("c_custkey", "reason")


@query(f"""
WITH RECURSIVE {HALVING}, walked AS (SELECT p_partkey AS node FROM part WHERE p_size < 10), w(node) AS (SELECT p_partkey FROM part WHERE p_size > 45 UNION SELECT e.b FROM w JOIN e ON e.a = w.node WHERE e.b NOT IN (SELECT node FROM walked))
SELECT node FROM w""")
def uncalled_closure(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    node = lambda c: part.where(c).select(F.col("p_partkey").alias("node"))
    return graph.uncalled(node("p_size > 45"), halving(spark, sf_dir), node("p_size < 10"))


@query(f"""
WITH RECURSIVE {HALVING}, s AS (SELECT p_partkey AS node FROM part WHERE p_size % 3 > 0), w(callee, spot) AS (SELECT a, b FROM e WHERE a % 5 = 0 AND b IN (SELECT node FROM s) UNION SELECT w.callee, e.b FROM w JOIN e ON e.a = w.spot WHERE e.b IN (SELECT node FROM s))
SELECT DISTINCT w.callee, e.b AS anchor FROM w JOIN e ON e.a = w.spot WHERE e.b NOT IN (SELECT node FROM s)""")
def shifted_attribution(spark, sf_dir):
    """A part's half calls it; parts of a size that 3 does not divide are plumbing."""
    callers = halving(spark, sf_dir).toDF("callee", "caller")
    plumbing = read(spark, sf_dir, "part").where("p_size % 3 > 0").select(F.col("p_partkey").alias("node"))
    return graph.shifted_attribution(callers.where("callee % 5 = 0"), callers, plumbing).select("callee", "anchor")


@query(f"""
WITH RECURSIVE {HALVING}, g AS (SELECT p_partkey AS key, p_brand AS type FROM part WHERE p_size = 3 UNION SELECT p_partkey, 'bound' FROM part WHERE p_size = 9),
w(key, type) AS (SELECT key, type FROM g UNION SELECT e.a, w.type FROM w JOIN e ON e.b = w.key),
o(key) AS (SELECT p_partkey FROM part WHERE p_size = 9 UNION SELECT e.b FROM e WHERE e.b NOT IN (SELECT a FROM e) AND e.b NOT IN (SELECT key FROM g)),
ow(key) AS (SELECT key FROM o UNION SELECT e.a FROM ow JOIN e ON e.b = ow.key), k AS (SELECT a AS key FROM e UNION SELECT b FROM e UNION SELECT key FROM g)
SELECT k.key, coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM w WHERE w.key = k.key), '') AS types, k.key IN (SELECT key FROM ow) AS open FROM k""")
def closed_parameters(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    given = part.where("p_size = 3").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("type"))
    bounds = part.where("p_size = 9").select(F.col("p_partkey").alias("key"), F.array(F.lit("bound")).alias("types"), F.lit(True).alias("open"))
    out = graph.resolved_parameters(given, halving(spark, sf_dir).toDF("key", "from_key"), bounds)
    return out.withColumn("types", F.array_join("types", ","))


@query("""
WITH d AS (SELECT p_partkey AS def, p_brand AS var, list_filter([CASE WHEN p_size % 4 > 0 THEN 'f' || p_size % 4 END, CASE WHEN p_size % 8 > 4 THEN 'g' || p_size % 2 END], lambda x: x IS NOT NULL) AS path, p_size % 5 = 0 AS strong FROM part)
SELECT k.def AS killer, d.def AS killed FROM d k JOIN d ON k.var = d.var AND k.def <> d.def AND k.strong AND d.path[1:len(k.path)] = k.path AND len(d.path) >= len(k.path)""")
def definition_kills(spark, sf_dir):
    size = F.col("p_size")
    path = F.array_compact(F.array(F.when(size % 4 > 0, F.concat(F.lit("f"), (size % 4).cast("string"))), F.when(size % 8 > 4, F.concat(F.lit("g"), (size % 2).cast("string")))))
    defs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("def"), F.col("p_brand").alias("var"), path.alias("path"), (size % 5 == 0).alias("strong"))
    return graph.prefix_kills(defs, defs.drop("strong"))


CYCLES = "c AS (SELECT s_suppkey AS src, (s_suppkey * 3 + 1) % 60 AS dst FROM supplier UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier)"


@query(f"""
WITH RECURSIVE {CYCLES}, a AS (SELECT s_suppkey AS v, 'o' || s_nationkey AS o FROM supplier WHERE s_acctbal < 0), w(v, o) AS (SELECT v, o FROM a UNION SELECT c.dst, w.o FROM w JOIN c ON c.src = w.v) SELECT v, o FROM w""")
def cycle_collapse(spark, sf_dir):
    """Copies with cycles, solved once for each cycle; then every variable has its representative's objects."""
    supplier = read(spark, sf_dir, "supplier")
    copies = supplier.selectExpr("(s_suppkey * 3 + 1) % 60 AS dst", "s_suppkey AS src").union(supplier.selectExpr("s_suppkey div 2", "s_suppkey")).distinct()
    addr = supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("v"), F.concat(F.lit("o"), F.col("s_nationkey").cast("string")).alias("o"))
    few, fewer, reps = pointsto.collapsed(addr, copies)
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    none = spark.createDataFrame([], "dst string, src string, ptr string")
    solved = pointsto.inclusion(text(few), text(fewer), none.select("dst", "ptr"), none.select("ptr", "src")).withColumnRenamed("v", "rep")
    named = reps.select("v", F.col("rep").cast("string").alias("rep"))
    alone = solved.join(named.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").cast("long").alias("v"), "o")
    return solved.join(named, "rep").select("v", "o").unionByName(alone)


@query("""
WITH b AS (SELECT l_partkey AS body, 'd' || l_linenumber AS dst, 's' || l_suppkey % 3 AS src FROM lineitem WHERE l_returnflag = 'R'), lib AS (SELECT p_partkey AS body FROM part WHERE p_size > 40), calls AS (SELECT DISTINCT l_orderkey AS context, l_partkey AS body FROM lineitem)
SELECT dst, src FROM b WHERE body NOT IN (SELECT body FROM lib) UNION ALL SELECT context || '/' || dst, context || '/' || src FROM b JOIN lib USING (body) JOIN calls USING (body)""")
def context_clones(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    copies = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("body"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("dst"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("src"))
    library = read(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("body"))
    return pointsto.cloned(copies, lines.select(F.col("l_orderkey").alias("context"), F.col("l_partkey").alias("body")), library)


@query("""
SELECT DISTINCT l_partkey AS object, l_linenumber AS "offset" FROM lineitem JOIN (SELECT p_partkey, p_size % 5 AS lo, p_size % 4 AS size, p_size = 9 AS every FROM part) ON p_partkey = l_partkey WHERE size > 0 AND (every OR (l_linenumber >= lo AND l_linenumber < lo + size))""")
def ranged_havoc(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    havoc = part.select(F.col("p_partkey").alias("object"), (F.col("p_size") % 5).alias("lo"), (F.col("p_size") % 4).alias("size"))
    smashed = part.where("p_size = 9").select(F.col("p_partkey").alias("object"))
    return pointsto.havocked(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_linenumber").alias("offset")), havoc, smashed)


@query("""
WITH m AS (SELECT c_custkey AS k, c_nationkey AS t FROM customer), r(t, d) AS (SELECT n_nationkey, n_regionkey FROM nation)
SELECT k, min(d) AS d FROM m JOIN r USING (t) GROUP BY k HAVING count(DISTINCT d) = 1""")
def constructors_elsewhere(spark, sf_dir):
    """A constructor that links lead to, where all agree on it."""
    linked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("t")).join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("t"), F.col("n_regionkey").alias("d")), "t")
    return joins.only_value(linked, ["k"], "d")


@query("""
SELECT l_suppkey, string_agg(v, ',' ORDER BY k) AS parts FROM (SELECT l_suppkey, CASE WHEN k > 5 THEN '...' ELSE v END AS v, k FROM (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey::VARCHAR AS v FROM lineitem)) WHERE k <= 6) GROUP BY l_suppkey""")
def capped_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("v"))
    return merges.capped_rows(rows, ["l_suppkey"], "v", 5, "...").select("l_suppkey", F.array_join("v", ",").alias("parts"))


