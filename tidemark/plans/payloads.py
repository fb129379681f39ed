"""Registered queries of payload readers. The texts are put together from the tables; the SQL takes the figures straight from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads
from .queries import query
from .views import r6, shared, table

_PRICE = "CAST(CAST(o_custkey % 9 + 1 AS INT) AS STRING) || '.' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')"
_NUMBER = "(o_custkey % 9 + 1 + (o_orderkey % 100) / 100.0)"
_OUTRIGHT_TEXT = """SELECT o_orderkey AS file, '[' || CASE o_orderkey % 3 WHEN 0 THEN '{{"event_id": ' || CAST(o_custkey AS STRING) || ', "date": "2024-01-02", "player_name": "p", "dg_id": 5, "odds": {{"x": """ + "' || " + _PRICE + """ || ', "y": "n/a", "z": 3}}}}'
 WHEN 1 THEN '{{"event_name": "open", "name": "q", "odds": """ + "' || " + _PRICE + """ || ', "book": "b"}}' ELSE '{{"event_name": "open", "odds": null}}' END || ']' AS json FROM {orders}"""


@query(f"""SELECT file, tournament_id, book, round(odds, 6) AS decimal_odds, round(1 / odds, 6) AS implied_prob FROM (SELECT o_orderkey AS file, CAST(o_custkey AS VARCHAR) AS tournament_id, unnest(['x', 'z']) AS book, unnest([{_NUMBER}, 3.0]) AS odds FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, 'open', 'b', {_NUMBER} FROM orders WHERE o_orderkey % 3 = 1)""")
def s12_outright_odds(spark, sf):
    """Records whose odds are an object of books, one number, or nothing."""
    got = payloads.outright_odds(shared(spark, sf, _OUTRIGHT_TEXT))
    return got.select("file", "tournament_id", "book", r6("decimal_odds", "decimal_odds"), r6("implied_prob", "implied_prob"))


_PROPS_TEXT = """SELECT o_orderkey AS file, '{{"id": "g' || CAST(o_custkey AS STRING) || '", "bookmakers": [{{"key": "a", "markets": [{{"key": "points", "outcomes": [{{"name": "Over", "description": "p", "price": ' || CAST(o_orderkey % 300 - 400 AS STRING) || ', "point": """ + "' || " + _PRICE + """ || '}}, {{"name": "Under", "price": "none"}}]}}, {{"key": "empty"}}]}}, {{"title": "b"}}]}}' AS json FROM {orders}"""


@query(f"""SELECT o_orderkey AS file, 'g' || o_custkey AS event_id, 'a' AS book, 'points' AS market, CASE side WHEN 'Over' THEN 'p' END AS player, side, CASE side WHEN 'Over' THEN (o_orderkey % 300 - 400)::DOUBLE END AS price, CASE side WHEN 'Over' THEN round({_NUMBER}, 6)::DOUBLE END AS line
 FROM orders, (SELECT unnest(['Over', 'Under']) AS side)""")
def s13_prop_lines(spark, sf):
    """Books, markets and outcomes of an event to a row an outcome."""
    got = payloads.prop_lines(shared(spark, sf, _PROPS_TEXT))
    return got.select("file", "event_id", "book", "market", "player", "side", "price", r6("line", "line"))


_ROUNDS_TEXT = """SELECT o_custkey AS file, '[' || concat_ws(',', collect_list('{{"event_id": ' || CAST(year(o_orderdate) AS STRING) || ', "dg_id": ' || CAST(o_custkey AS STRING) || ', "player_name": "p' || CAST(o_custkey AS STRING) || '", "round_num": ' || CAST(o_orderkey AS STRING) || ', "score": ' || CAST(60 + o_orderkey % 30 AS STRING)
 || ', "sg_total": ' || CASE WHEN o_orderkey % 5 = 0 THEN '"bad"' ELSE CAST(o_orderkey % 7 AS STRING) END || ', "year": ' || CAST(year(o_orderdate) AS STRING) || ', "fin_text": "T' || CAST(o_custkey % 50 AS STRING) || '"}}')) || ']' AS json FROM {orders} GROUP BY o_custkey"""


@query("""SELECT CAST(y AS VARCHAR) AS tournament_id, 'p' || o_custkey AS player_name, sum(60 + o_orderkey % 30)::DOUBLE AS total_score, count(*) AS rounds_played, round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END), 6) AS sg_total_avg, (o_custkey % 50)::DOUBLE AS finish_position, count(*) >= 4 AS made_cut
 FROM (SELECT *, year(o_orderdate) AS y FROM orders) WHERE y >= 1997 GROUP BY y, o_custkey""")
def s14_golf_results(spark, sf):
    """Rounds of nested records from a year on, and the results that they add up to."""
    got = payloads.golf_results(payloads.golf_rounds(shared(spark, sf, _ROUNDS_TEXT), 1997))
    return got.select("tournament_id", "player_name", "total_score", "rounds_played", r6("sg_total_avg", "sg_total_avg"), "finish_position", "made_cut")


_LISTED_TEXT = "SELECT 't.' || CAST(s_suppkey AS STRING) AS `Symbol`, s_name AS `Security`, 'S' || CAST(s_nationkey AS STRING) AS `GICS Sector`, 'sub' AS `GICS Sub-Industry`, CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE '20' || lpad(CAST(s_suppkey % 20 AS STRING), 2, '0') || '-03-04' END AS `Date added`, CAST(s_suppkey AS STRING) AS `CIK` FROM {supplier}"


@query("SELECT 'T-' || s_suppkey AS ticker, s_name AS name, 'S' || s_nationkey AS gics_sector, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1957-03-04' ELSE make_date(2000 + s_suppkey % 20, 3, 4) END AS start_date, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier")
def s15_constituents(spark, sf):
    """A scraped table with headers as they come."""
    return payloads.constituents(shared(spark, sf, _LISTED_TEXT)).select("ticker", "name", "gics_sector", "start_date", "cik")


_CHANGED_TEXT = "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS `Date|Date`, 'a' || CAST(o_custkey AS STRING) AS `Added|Ticker`, 'n' AS `Added|Security`, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || CAST(o_custkey + 1 AS STRING) END AS `Removed|Ticker`, NULL AS `Removed|Security`, ' why ' AS `Reason|` FROM {orders}"


@query("SELECT CAST(o_orderdate AS DATE) AS event_date, 'A' || o_custkey AS added_ticker, 'n' AS added_name, CASE WHEN o_orderkey % 2 = 0 THEN 'A' || (o_custkey + 1) ELSE '' END AS removed_ticker, '' AS removed_name, 'why' AS reason FROM orders WHERE o_orderkey % 7 <> 0")
def s16_change_events(spark, sf):
    return payloads.change_events(shared(spark, sf, _CHANGED_TEXT))


@query("""WITH e AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey AS c, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0), v AS (SELECT 'A' || c AS ticker, d FROM e UNION ALL SELECT 'A' || (c + 1), d FROM e WHERE o_orderkey % 2 = 0)
 SELECT ticker, count(*) AS events, min(d) AS first FROM v GROUP BY 1""")
def s16_events_by_ticker(spark, sf):
    """Change events as additions and removals, the form that memberships are built from."""
    got = payloads.as_events(payloads.change_events(shared(spark, sf, _CHANGED_TEXT)))
    return got.groupBy("ticker").agg(F.count("*").alias("events"), F.min("d").alias("first"))


_PERCENT_TEXT = """SELECT 'f' || CAST(o_custkey % 10 AS STRING) AS file, concat_ws(chr(10), 'Some title', '', ', one, two', concat_ws(chr(10), array_sort(collect_list(CAST(year(o_orderdate) AS STRING) || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || ', ' || CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 90 AS STRING) || '.25' END || ', -99.99'))), '', 'Monthly', ', one', '199702, 1.5', 'Copyright') AS value FROM {orders} GROUP BY o_custkey % 10"""


@query("""SELECT file, block, d, name, round(value, 6) AS value, count(*) AS n FROM (SELECT 'f' || o_custkey % 10 AS file, 1 AS block, CAST(o_orderdate AS DATE) AS d, 'one' AS name, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 90 + 0.25) / 100 END AS value FROM orders
 UNION ALL SELECT 'f' || o_custkey % 10, 1, CAST(o_orderdate AS DATE), 'two', NULL FROM orders UNION ALL SELECT DISTINCT 'f' || o_custkey % 10, 2, DATE '1997-02-28', 'one', 0.015 FROM orders) GROUP BY ALL""")
def s10_percent_blocks(spark, sf):
    """Files with a daily and a monthly block, each with its own header; bad cells are null."""
    got = payloads.percent_blocks(shared(spark, sf, _PERCENT_TEXT).repartition(4)).withColumn("value", r6("value", "value"))
    return got.groupBy("file", "block", "d", "name", "value").agg(F.count("*").alias("n"))


_CODES = {f"h{k}": f"H{k}" for k in range(20) if k % 6}


@query("""SELECT CAST(o_orderdate AS DATE) AS game_date, CASE WHEN o_custkey % 20 % 6 <> 0 THEN 'H' || o_custkey % 20 END AS home, CASE WHEN o_orderkey % 20 % 6 <> 0 THEN 'H' || o_orderkey % 20 END AS away, CAST(o_orderkey % 9 > o_custkey % 9 AS INT) AS home_win, CAST(o_orderkey % 9 + o_custkey % 9 AS INT) AS total, o_orderkey AS game_num
 FROM orders WHERE year(o_orderdate) >= 1997""")
def p7_game_logs(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date"), F.concat(F.lit("h"), F.col("o_custkey") % 20).alias("home_team"), F.concat(F.lit("h"), F.col("o_orderkey") % 20).alias("visiting_team"), (F.col("o_orderkey") % 9).alias("home_score"), (F.col("o_custkey") % 9).alias("visiting_score"), F.col("o_orderkey").alias("game_num"))
    return payloads.log_games(raw, _CODES, 1997).select("game_date", "home", "away", "home_win", "total", "game_num")


@query("""SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS game_date, CASE WHEN o_custkey % 20 % 6 <> 0 THEN 'H' || o_custkey % 20 END AS home, (o_orderkey % 300 - 400)::DOUBLE AS home_close_ml, CASE WHEN o_orderkey % 4 <> 1 THEN 110.0::DOUBLE END AS away_open_ml FROM orders WHERE o_orderkey % 3 <> 0""")
def p8_odds(spark, sf):
    o, text = table(spark, sf, "orders"), lambda c: F.col(c).cast("string")
    ml = (F.col("o_orderkey") % 300 - 400).cast("string")
    raw = o.select(F.year("o_orderdate").alias("season"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("x")).alias("date"), F.concat(F.lit("h"), text("o_custkey").cast("long") % 20).alias("home_team"), F.lit("none").alias("away_team"), F.lit("x").alias("home_open_ml"), F.when(F.col("o_orderkey") % 4 == 1, "NL").otherwise("110").alias("away_open_ml"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(ml).alias("home_close_ml"), F.lit("100").alias("away_close_ml"))
    return payloads.log_odds(raw, _CODES).select("season", "game_date", "home", "home_close_ml", "away_open_ml")


_NAMES = "(SELECT DISTINCT p_name AS name FROM part)"


@query(f"""WITH s AS (SELECT name, list_distinct([('^' || lower(name) || '$')[i : i + 1] FOR i IN range(1, length(name) + 2)]) AS q FROM {_NAMES})
 SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.q, b.q)) / len(list_distinct(a.q || b.q)), 6) AS similarity FROM s a JOIN s b ON a.name < b.name WHERE len(list_intersect(a.q, b.q)) / len(list_distinct(a.q || b.q)) >= 0.5 - 1e-9""")
def y44_similar_names(spark, sf):
    """All pairs of part names whose letter pairs are alike, found by their rare pairs and verified."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return payloads.similar_names(names, 0.5).select("a", "b", r6("similarity", "similarity"))


@query("""SELECT c, f, cd AS current_in_data, fd AS former_in_data, cov AS in_former_names, fd AND NOT cov AS needs_merge FROM (SELECT s_name AS c, 'Old ' || s_name AS f, s_suppkey % 2 = 0 AS cd, s_suppkey % 3 = 0 AS fd, s_suppkey % 6 = 0 AS cov FROM supplier)""")
def y44_merge_checks(spark, sf):
    s = table(spark, sf, "supplier")
    old = F.concat(F.lit("Old "), "s_name")
    pairs = s.select(F.col("s_name").alias("current"), old.alias("former"))
    teams = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name")).unionByName(s.where("s_suppkey % 3 = 0").select(old.alias("name")))
    got = payloads.merge_checks(pairs, teams, s.where("s_suppkey % 6 = 0").select(old.alias("name")))
    return got.withColumnsRenamed({"current": "c", "former": "f"})


@query("SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 4 <> 0 THEN make_date(2000 + s_suppkey % 20, 3, 4) END AS inception_date, CASE WHEN s_suppkey % 4 = 0 THEN 'inception_date' ELSE '' END AS rejected FROM supplier")
def s5_s6_universe(spark, sf):
    """A universe's dates parsed; what cannot be read is null and named."""
    raw = shared(spark, sf, _LISTED_TEXT).select(F.col("CIK").cast("long").alias("ticker"), F.col("`Date added`").alias("inception_date"), F.lit("").alias("closure_date"))
    return payloads.universe(raw, payloads.FUTURES_DATES).select("ticker", "inception_date", F.array_join("rejected", ",").alias("rejected"))
