"""Queries on checks, geometry and near-equal groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import hyetograph
from ..operators import checks, contracts, digests, geometry, network, overlay
from .model_queries import log_table
from .registry import query, table
from .series_queries import samples


@query("WITH r AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, event_id FROM events), x AS (SELECT user_id, s, CASE WHEN event_id % 10 = 0 THEN l - INTERVAL 1 SECOND ELSE l END AS e FROM r WHERE l IS NOT NULL), p AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS p FROM x) SELECT user_id, count(*) AS n FROM p WHERE p IS NOT NULL AND p <> s GROUP BY 1")
def contiguity(spark, sf):
    e = samples(spark, sf).withColumn("l", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("l is not null")
    r = e.select("user_id", F.col("ts").alias("start"), F.expr("if(event_id % 10 = 0, l - interval 1 second, l)").alias("end"))
    return checks.gaps(r, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT o_orderpriority, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 30 MINUTE * (o_orderkey % 48) AS ts FROM orders),
f AS (SELECT *, year(ts) AS y, dayofweek(ts) AS d FROM o),
c AS (SELECT *, month(ts) = 4 AND d = 0 AND day(ts) <= 7 AS spring, month(ts) = 10 AND d = 0 AND day(ts) >= 25 AS autumn FROM f),
k AS (SELECT *, spring AND hour(ts) = 2 AS skipped, autumn AND hour(ts) = 1 AS twice,
  CASE WHEN month(ts) BETWEEN 5 AND 9 THEN TRUE WHEN month(ts) IN (1, 2, 3, 11, 12) THEN FALSE
    WHEN month(ts) = 4 THEN day(ts) - d > 7 OR day(ts) - d BETWEEN 1 AND 7 AND NOT (spring AND hour(ts) < 2) ELSE day(ts) - d < 25 OR autumn AND hour(ts) < 1 END AS summer FROM c)
SELECT o_orderpriority, count(*) FILTER (skipped) AS nonexistent, count(*) FILTER (twice) AS ambiguous, count(DISTINCT summer) AS offsets FROM k GROUP BY 1"""
)
def wall_clock(spark, sf):
    """Half-hour stamps of the order dates, whose years change their clocks in April and October."""
    o = table(spark, sf, "orders").selectExpr("o_orderpriority", "cast(timestampadd(MINUTE, 30 * (o_orderkey % 48), cast(o_orderdate as date)) as timestamp_ntz) as ts")
    return checks.wall_clock(o, ["o_orderpriority"], "America/Chicago")


@query("WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT DISTINCT event_type, i FROM events, range(49) AS r(i)) SELECT w.event_type, TIMESTAMP '2030-06-01' + INTERVAL 1 HOUR * w.i AS ts, round(v, 6) AS value FROM w LEFT JOIN h ON w.event_type = h.event_type AND h.ts = TIMESTAMP '2024-01-03' + INTERVAL 1 HOUR * w.i")
def window_translation(spark, sf):
    from ..operators import series

    h = series.resample(samples(spark, sf), ["event_type"])
    return checks.translate_window(h, ["event_type"], "2024-01-03 00:00:00", "2030-06-01 00:00:00", 48, 60).withColumn("value", F.round("value", 6))


@query("WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 2000), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal < 8000) SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v GROUP BY 1")
def block_differences(spark, sf):
    c = table(spark, sf, "customer")
    block = lambda d, v: d.select(F.lit("Customer").alias("kind"), F.col("c_custkey").cast("string").alias("name"), F.create_map(F.lit("Segment"), v).alias("attrs"))
    a = block(c.where("c_acctbal > 2000"), F.col("c_mktsegment"))
    b = block(c.where("c_acctbal < 8000"), F.expr("if(c_custkey % 5 = 0, 'other', c_mktsegment)"))
    return checks.block_differences(a, b).groupBy("status").agg(F.count("*").alias("n"))


SAID = ["DSS file has an old VERSION", "unknown loss Method", "Option Deprecated", "is NOT now supported", "Cannot open the Project", "unable to load gage", "all well", "version of a DSS file", "supported, but not here"]
SQL_SAID = "[" + ", ".join(f"'{m}'" for m in SAID) + "]"


@query(
    f"""WITH m AS (SELECT user_id, lower({SQL_SAID}[(event_id * 7 + user_id) % 41 % 9 + 1]) AS m FROM events WHERE (event_id * 7 + user_id) % 41 % 9 < CASE WHEN user_id % 3 = 0 THEN 9 ELSE user_id % 9 + 1 END),
h AS (SELECT user_id, bool_or(m LIKE '%dss file%version%') AS a, bool_or(m LIKE '%unknown%method%') AS b, bool_or(m LIKE '%deprecated%') AS c, bool_or(m LIKE '%not%supported%') AS d, bool_or(m LIKE '%cannot%open%project%') AS e, bool_or(m LIKE '%unable%load%') AS f FROM m GROUP BY 1)
SELECT user_id, concat_ws(';', CASE WHEN a THEN 'DSS file version incompatibility' END, CASE WHEN b THEN 'Unknown method - may need parameter update' END, CASE WHEN c THEN 'Deprecated feature' END,
  CASE WHEN d THEN 'Feature not supported in this version' END, CASE WHEN e THEN 'Project file format incompatibility' END, CASE WHEN f THEN 'Unable to load component - format change' END) AS issues FROM h WHERE a OR b OR c OR d OR e OR f"""
)
def upgrade_issues(spark, sf):
    said = F.array(*[F.lit(m) for m in SAID])
    m = table(spark, sf, "events").withColumn("_k", F.expr("cast((event_id * 7 + user_id) % 41 % 9 as int)")).where("_k < if(user_id % 3 = 0, 9, user_id % 9 + 1)")
    return checks.upgrade_issues(m.select("user_id", F.get(said, F.col("_k")).alias("message")), ["user_id"]).select("user_id", F.concat_ws(";", "issues").alias("issues"))


@query("SELECT user_id, event_id % 5 = 0 OR event_id % 7 = 0 AS fatal, count(*) AS n FROM events GROUP BY ALL")
def fatal_lines(spark, sf):
    line = F.expr("case when event_id % 5 = 0 then 'run: Exit status = 1' when event_id % 7 = 0 then 'ERROR 1: Error during computation of it' else 'exit status = 10' end")
    return table(spark, sf, "events").select("user_id", checks.fatal(line).alias("fatal")).groupBy("user_id", "fatal").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT user_id, event_id AS pos, event_id % 7 AS c, user_id % 5 AS u FROM events), r AS (SELECT user_id, any_value(u) AS u, count(*) FILTER (c = 1 AND u = 0) AS errors, arg_min(CASE WHEN c = 2 THEN 3 ELSE 0 END, pos) FILTER (c IN (2, 3) AND u = 1) AS ended, arg_min(c, pos) FILTER (c >= 4 AND u IN (1, 2)) AS script, count(*) FILTER (c = 5 AND u = 3) AS said FROM l GROUP BY user_id)
SELECT user_id, errors, CAST(coalesce(ended, script, -1) AS INT) AS exit_code, errors > 0 OR coalesce(ended, script, -1) NOT IN (0, -1) OR said > 0 AS fatal FROM r"""
)
def run_failures(spark, sf):
    """Errors, exit code and failure of each user's run, its lines in the order of the events."""
    line = F.expr(
        """case when user_id % 5 = 0 and event_id % 7 = 1 then 'ERROR 5:  cannot go on' when user_id % 5 = 1 and event_id % 7 = 2 then 'End Model 4.1 at noon; Exit status = 3'
when user_id % 5 = 1 and event_id % 7 = 3 then 'End Model 4.1 at noon; Exit status = 0' when user_id % 5 in (1, 2) and event_id % 7 >= 4 then concat('NOTE 12573:  End script "a"; Exit code ', event_id % 7)
when user_id % 5 = 3 and event_id % 7 = 5 then 'then: Error during computation' else 'no ERROR 5: of its own' end"""
    )
    return checks.fatal_runs(table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), line.alias("line")), ["user_id"])


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS n_missing, count(*) FILTER (event_id % 4 = 0) AS n_unknown FROM events")
def closed_keys(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.expr("if(event_id % 3 = 0, '{', '{\"a\": 1, ')"), F.expr("if(event_id % 4 = 0, '\"c\": 2, ', '')"), F.lit('"b": 0}')).alias("j"))
    out = checks.closed_keys(e, "j", ["a", "b"])
    return out.agg(F.count("*").alias("n"), F.count_if(F.size("missing") > 0).alias("n_missing"), F.count_if(F.size("unknown") > 0).alias("n_unknown"))


@query(
    """WITH l AS (SELECT l_returnflag || l_linestatus AS l_shipmode, concat_ws(',', l_orderkey, l_linenumber, l_partkey) AS l FROM lineitem),
c AS (SELECT l_shipmode, md5(l)[1:3] AS c, sha256(array_to_string(list_sort(list(l)), chr(10))) AS s, count(*) AS n FROM l GROUP BY 1, 2)
SELECT l_shipmode, sha256(array_to_string(list_sort(list(c || ':' || s)), ',')) AS sha256, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"""
)
def content_digest(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus"))
    return checks.content_digest(li, ["l_shipmode"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    """WITH v AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events), b AS (SELECT *, len(bin(v)) - 1 AS e FROM v),
h AS (SELECT user_id, ts, event_id, printf('%016x', CASE WHEN v = 0 THEN 0 ELSE (1023 + e)::BIGINT * 4503599627370496 + (v - (1::BIGINT << e::INT)) * (1::BIGINT << (52 - e)::INT) END) AS h FROM b)
SELECT user_id, count(*) AS n, sha256(unhex(string_agg(array_to_string(list_reverse(regexp_extract_all(h, '..')), ''), '' ORDER BY ts, event_id))) AS ordinate_sha256, sha256(string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), chr(10) ORDER BY ts, event_id)) AS timestamp_sha256 FROM h GROUP BY user_id"""
)
def series_digest(spark, sf):
    """Digests of each user's series, in hundredths, byte for byte."""
    return digests.series_digests(samples(spark, sf).withColumn("value", F.round(F.col("value") * 100)), ["user_id"], "event_id")


def squares(spark, sf):
    """A square for each supplier, as vertices."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_suppkey % 7 * 3d as x", "s_suppkey % 5 * 4d as y")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for i, (a, b) in enumerate(((0.0, 0.0), (2.5, 0.0), (2.5, 3.5), (0.0, 3.5)))]))
    return s.withColumn("c", corner).select("id", "c.ord", (F.col("x") + F.col("c.dx")).alias("x"), (F.col("y") + F.col("c.dy")).alias("y"))


@query("SELECT c_custkey AS point, s_suppkey AS id FROM customer JOIN supplier ON c_custkey % 41 * 0.5 + 0.1 > s_suppkey % 7 * 3 AND c_custkey % 41 * 0.5 + 0.1 < s_suppkey % 7 * 3 + 2.5 AND c_custkey % 37 * 0.5 + 0.1 > s_suppkey % 5 * 4 AND c_custkey % 37 * 0.5 + 0.1 < s_suppkey % 5 * 4 + 3.5")
def points_within(spark, sf):
    p = table(spark, sf, "customer").selectExpr("c_custkey as point", "c_custkey % 41 * 0.5d + 0.1d as px", "c_custkey % 37 * 0.5d + 0.1d as py")
    return geometry.within(p, squares(spark, sf), 2.0)


@query("WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 * 3.0 AS x, s_suppkey % 5 * 4.0 AS y FROM supplier), c AS (SELECT id, col, \"row\", greatest(0, least(col + 1, x + 2.5) - greatest(col, x)) * greatest(0, least(\"row\" + 1, y + 3.5) - greatest(\"row\", y)) AS a FROM s, range(30) AS a(col), range(30) AS b(\"row\")) SELECT id, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(a) AS DOUBLE), 6) AS area FROM c WHERE a > 0 GROUP BY id")
def polygon_cells(spark, sf):
    return overlay.cell_areas(squares(spark, sf), 1.0).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 AS b FROM customer UNION SELECT c_custkey, c_custkey - CASE WHEN c_custkey % 100 = 0 AND c_custkey % 300 > 0 THEN 100 ELSE 0 END FROM customer), s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT DISTINCT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.seen = s.a) SELECT node, min(seen) AS component FROM r GROUP BY node")
def near_equal_groups(spark, sf):
    c = table(spark, sf, "customer")
    a = c.selectExpr("c_custkey as src", "c_custkey - c_custkey % 10 as dst")
    b = c.selectExpr("c_custkey as src", "c_custkey - if(c_custkey % 100 = 0 and c_custkey % 300 > 0, 100, 0) as dst")
    return network.components(a.union(b))


@query("SELECT p_brand, CASE WHEN n = 1 THEN name END AS name, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, k FROM (SELECT p_brand, max(n) AS n, max(name) AS name, max(k) AS k FROM (SELECT p_brand, k, count(c.name) AS n, min(c.name) AS name FROM (SELECT p_brand, min(p_size) AS k FROM part GROUP BY 1) LEFT JOIN (VALUES (1, 2, 'a'), (2, 3, 'b'), (5, 9, 'c')) AS c(lo, hi, name) ON k BETWEEN lo AND hi GROUP BY 1, 2) GROUP BY 1)")
def duration_classes(spark, sf):
    s = table(spark, sf, "part").groupBy(F.col("p_brand").alias("storm_id")).agg(F.min("p_size").alias("hours"))
    classes = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (5, 9, "c")], "lo int, hi int, name string")
    out = hyetograph.duration_class(s, classes).join(s, "storm_id")
    return out.select(F.col("storm_id").alias("p_brand"), "name", "status", F.col("hours").alias("k"))


@query("SELECT p_brand, max(p_size) AS duration, round(arg_max(p_retailprice, p_partkey) FILTER (r = 1), 2) AS depth FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size * 100000 + p_partkey DESC) AS r FROM part) GROUP BY 1")
def curve_totals(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_brand", "p_size as duration", "struct(p_size * 100000 + p_partkey, p_partkey) as place", "p_retailprice as depth")
    return hyetograph.total_of_curve(p, ["p_brand"], "place").select("p_brand", "duration", F.round("depth", 2).alias("depth"))


def supplier_text(spark, sf):
    """Text files of bounded size: a block for each supplier of a nation and a thousand of keys."""
    one = F.concat(F.lit("Supplier: "), "s_name", F.lit("\n     Balance: "), F.col("s_acctbal").cast("string"), F.lit("\n     Tier: "), F.expr("if(s_acctbal > 5000, 'high', '')"), F.lit("\nEnd:\n"))
    s = table(spark, sf, "supplier").select(F.expr("concat(s_nationkey, '-', s_suppkey div 1000)").alias("file"), "s_suppkey", one.alias("t"))
    return s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "t"))), lambda x: x["t"]), "\n").alias("content"))


@query("SELECT s_nationkey || '-' || s_suppkey // 1000 AS file, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey) AS ordinal, s_name AS name, s_acctbal AS balance, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE '' END AS tier FROM supplier")
def block_scan(spark, sf):
    from ..sources import text

    b = text.blocks(text.lines(supplier_text(spark, sf)))
    return b.select("file", "ordinal", "name", F.element_at("attrs", F.lit("Balance")).cast("double").alias("balance"), F.element_at("attrs", F.lit("Tier")).alias("tier"))


@query("SELECT s_name AS name, CASE WHEN s_acctbal < 1000 THEN 0.0::DOUBLE ELSE s_acctbal END AS balance FROM supplier")
def block_edit(spark, sf):
    """Balances under 1000 set to 0 in the text, which is then written out and parsed again."""
    from ..sources import sinks, text

    b = text.blocks(text.lines(supplier_text(spark, sf)))
    low = b.select("kind", "name", F.element_at("attrs", F.lit("Balance")).cast("double").alias("v")).where("v < 1000")
    edited = sinks.edit_blocks(b, low.select("kind", "name", F.lit("Balance").alias("k"), F.lit("0.0").alias("v")))
    again = text.blocks(text.lines(sinks.block_text(edited)))
    return again.select("name", F.element_at("attrs", F.lit("Balance")).cast("double").alias("balance"))


CONTRACT = {
    "type": "object",
    "additionalProperties": False,
    "required": ["schema", "k", "user"],
    "properties": {
        "schema": {"const": "events/1"},
        "k": {"type": "integer", "minimum": 0, "maximum": 79},
        "user": {"$ref": "#/$defs/user"},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 1}},
    },
    "$defs": {"user": {"type": "object", "additionalProperties": False, "required": ["id", "kind"], "properties": {"id": {"type": "integer", "exclusiveMinimum": -1}, "kind": {"enum": ["a", "b"]}}}},
}
# What each document, by event_id % 11, has in place of a good one's parts: the number, the user, the tags, what follows them.
PLANTED = {1: ("{k}", "good", "good", ', "z": 1'), 2: ("none", "good", "good", ""), 3: ('"{k}"', "good", "good", ""), 4: ("{k}", '{{"id": {u}, "kind": "a", "x": null}}', "good", ""), 5: ("{k}", "good", "good", ', "k": 1'), 6: ("{k}", "good", '["p", 3, ""]', ""), 7: ("{k}", '{{"id": {u}, "kind": "c"}}', "good", ""), 8: ("{k}", "good", "good", ', "'), 9: ("{k}", '{{"kind": "b", "kind": "b", "id": 1}}', "good", ""), 10: ("{k}.5", "[1]", "[]", "")}


@query(
    """WITH e AS (SELECT event_id % 11 AS c, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
v AS (SELECT CASE c WHEN 5 THEN ['$: repeated key'] WHEN 9 THEN ['$: repeated key'] WHEN 8 THEN ['$: malformed'] ELSE list_sort(list_filter(list_concat(
  CASE WHEN c = 10 AND k >= 79 THEN ['$.k: above 79'] WHEN c NOT IN (2, 3, 10) AND k > 79 THEN ['$.k: above 79'] ELSE [] END,
  CASE c WHEN 1 THEN ['$.z: unknown'] WHEN 2 THEN ['$.k: missing'] WHEN 3 THEN ['$.k: not integer'] WHEN 4 THEN ['$.user.x: unknown'] WHEN 6 THEN ['$.tags[1]: not string', '$.tags[2]: shorter than 1']
    WHEN 7 THEN ['$.user.kind: not one of "a", "b"'] WHEN 10 THEN ['$.k: not integer', '$.tags: fewer than 1 items', '$.user: not object'] ELSE [] END), lambda x: x IS NOT NULL)) END AS p FROM e)
SELECT array_to_string(p, '; ') AS problems, count(*) AS n FROM v GROUP BY 1"""
)
def contract_violations(spark, sf):
    """Documents built from the events' properties, ten in eleven with a planted fault, against a closed nested contract."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("c", F.col("event_id") % 11)
    user, tags = '{{"id": {u}, "kind": "b"}}', '["p", "q"]'

    def document(k, u, t, more):
        whole = '{{"schema": "events/1"' + ("" if k == "none" else f', "k": {k}') + f', "user": {user if u == "good" else u}, "tags": {tags if t == "good" else t}{more}' + "}}"
        parts = whole.replace("{{", "\0").replace("}}", "\1").replace("{k}", "\2k\2").replace("{u}", "\2u\2").split("\2")
        return F.concat(*[F.col("k") if x == "k" else F.col("user_id").cast("string") if x == "u" else F.lit(x.replace("\0", "{").replace("\1", "}")) for x in parts if x])

    text = document("{k}", "good", "good", "")
    for c, planted in PLANTED.items():
        text = F.when(F.col("c") == c, document(*planted)).otherwise(text)
    found = contracts.check(e.select(text.alias("text")), "text", CONTRACT)
    return found.groupBy(F.array_join("violations", "; ").alias("problems")).agg(F.count("*").alias("n"))
