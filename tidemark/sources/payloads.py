"""Payloads whose layout varies: JSON by variant paths, tables with several headers, files of several blocks. Bad cells become null, rows are never lost silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import company_number, ticker_symbol
from .files import require

UNIVERSE = "ticker string, name string, inception_date string, expense_ratio double, category string, aum_billions double"
FUTURES_DATES = ("closure_date", "benchmark_change_date", "reverse_split_date")
DELISTINGS = "ticker string, delist_date string, delist_return double, reason string"
#: Members of the first list count from the day that the index began.
INDEX_BEGAN = "1957-03-04"


def day_of(text: Column) -> Column:
    """A date of ISO text, or of text such as `March 4, 1957`; null if it is neither."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd"))
    return F.coalesce(iso, F.try_to_date(F.regexp_extract(text, r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1), "MMMM d, yyyy"))


def universe(raw: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """A universe's rows with dates parsed, inception_date and those of `dates` that are there; a date that cannot be read is null, in `rejected` its column is named."""
    found = ["inception_date", *[c for c in dates if c in raw.columns]]
    require(raw, ["ticker", "inception_date"])
    bad = F.array_compact(F.array(*[F.when((F.trim(F.col(c)) != "") & day_of(F.col(c)).isNull(), F.lit(c)) for c in found]))
    return raw.withColumn("rejected", bad).withColumns({c: day_of(F.col(c)) for c in found})


def delisting_table(raw: DataFrame) -> DataFrame:
    """(ticker, delist_date, delist_return, reason): a null return is none, a null reason empty, rows without a day are dropped."""
    require(raw, ["ticker", "delist_date", "delist_return"])
    reason = F.coalesce("reason", F.lit("")) if "reason" in raw.columns else F.lit("")
    got = raw.select("ticker", day_of(F.col("delist_date").cast("string")).alias("delist_date"), F.coalesce(F.col("delist_return").try_cast("double"), F.lit(0.0)).alias("delist_return"), reason.alias("reason"))
    return got.where("delist_date is not null")


def percent_blocks(files: DataFrame, text: str = "value") -> DataFrame:
    """(the other columns, block, d, name, value) of every data block of percent files, a text a row.

    A block is a run of lines that begin with a date (YYYYMMDD, or YYYYMM for its last day); the line before it, blank ones aside, names its columns. Percents become
    fractions; cells that are no numbers, -99.99 and -999 are null. Blocks are numbered from 1 in each text.
    """
    kept = [c for c in files.columns if c != text]
    rows = files.withColumn("_file", F.monotonically_increasing_id()).select(*kept, "_file", F.posexplode(F.split(text, r"\r?\n")).alias("_at", "_line")).where(F.trim("_line") != "")
    o = W.partitionBy("_file").orderBy("_at")
    cells = F.transform(F.split("_line", ","), lambda c: F.trim(c))
    rows = rows.withColumn("_cells", cells).withColumn("_is", F.col("_line").rlike(r"^\s*(\d{6}|\d{8})\s*,"))
    rows = rows.withColumn("_new", F.col("_is") & ~F.coalesce(F.lag("_is").over(o), F.lit(False))).withColumn("_head", F.when(F.col("_new"), F.lag("_cells").over(o)))
    upto = o.rowsBetween(W.unboundedPreceding, 0)
    data = rows.withColumn("block", F.sum(F.col("_new").cast("int")).over(upto)).withColumn("_head", F.last("_head", ignorenulls=True).over(upto)).where("_is")
    first = F.col("_cells")[0]
    day = F.when(F.length(first) == 8, F.try_to_date(first, "yyyyMMdd")).otherwise(F.last_day(F.try_to_date(F.concat(first, F.lit("01")), "yyyyMMdd")))
    each = data.select(*kept, "block", day.alias("d"), "_head", F.posexplode("_cells").alias("_i", "_v")).where("_i > 0 and d is not null")
    number = F.col("_v").try_cast("double")
    name = F.coalesce(F.get("_head", F.col("_i")), F.concat(F.lit("column "), F.col("_i").cast("string")))
    return each.select(*kept, "block", "d", name.alias("name"), F.when(~number.isin(-99.99, -999.0), number / 100).alias("value"))


def _first(v: str, names: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _records(raw: DataFrame, json: str) -> DataFrame:
    """The other columns and `v`, a row a record of each text's array; a text that is no JSON gives none."""
    kept = [c for c in raw.columns if c != json]
    return raw.select(*kept, F.explode(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")).alias("v"))


def outright_odds(raw: DataFrame, json: str = "json") -> DataFrame:
    """(the other columns, tournament_id, event_date, player_name, player_id, book, decimal_odds, implied_prob): a row a book.

    A record's odds are an object of books, of which only numbers count, or one number (or text of one) with its book, `unknown` if it names none. Rows without odds are dropped.
    """
    kept = [c for c in raw.columns if c != json]
    head = [_first("v", ("event_id", "event_name")).alias("tournament_id"), day_of(_first("v", ("date", "event_date"))).alias("event_date"), _first("v", ("player_name", "name")).alias("player_name"), _first("v", ("dg_id", "player_id")).alias("player_id")]
    rows = _records(raw, json).withColumn("_books", F.try_variant_get("v", "$.odds", "map<string,variant>"))
    number = F.when(F.schema_of_variant("_line").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get("_line", "$", "double"))
    many = rows.where("_books is not null").select(*kept, *head, F.explode("_books").alias("book", "_line")).withColumn("decimal_odds", number).drop("_line")
    one = rows.where("_books is null").select(*kept, *head, F.coalesce(_first("v", ("book",)), F.lit("unknown")).alias("book"), _first("v", ("odds", "decimal_odds"), "double").alias("decimal_odds"))
    return many.unionByName(one).where("decimal_odds is not null").withColumn("implied_prob", F.try_divide(F.lit(1.0), "decimal_odds"))


def prop_lines(raw: DataFrame, json: str = "json") -> DataFrame:
    """(the other columns, event_id, book, market, player, side, price, line): bookmakers > markets > outcomes, a row an outcome."""
    kept = [c for c in raw.columns if c != json]
    event = raw.select(*kept, F.try_parse_json(json).alias("v"))
    inner = lambda df, path, out, *more: df.select(*more, F.explode(F.try_variant_get("v", path, "array<variant>")).alias(out))
    books = inner(event.withColumn("event_id", _first("v", ("id", "event_id"))), "$.bookmakers", "b", *kept, "event_id")
    markets = inner(books.withColumn("v", F.col("b")).withColumn("book", _first("b", ("key", "title"))), "$.markets", "m", *kept, "event_id", "book")
    outcomes = inner(markets.withColumn("v", F.col("m")).withColumn("market", _first("m", ("key",))), "$.outcomes", "o", *kept, "event_id", "book", "market")
    return outcomes.select(*kept, "event_id", "book", "market", _first("o", ("description",)).alias("player"), _first("o", ("name",)).alias("side"), _first("o", ("price",), "double").alias("price"), _first("o", ("point",), "double").alias("line"))


SHOTS = ("sg_total", "sg_ott", "sg_app", "sg_arg", "sg_putt")


def golf_rounds(raw: DataFrame, least_year: int, json: str = "json") -> DataFrame:
    """(the other columns, tournament_id, player_id, player_name, round_number, score, the SHOTS, year, finish_text): a row a round, from least_year on; figures that are no numbers are null."""
    kept = [c for c in raw.columns if c != json]
    rows = _records(raw, json)
    got = rows.select(*kept, _first("v", ("event_id",)).alias("tournament_id"), _first("v", ("dg_id",)).alias("player_id"), _first("v", ("player_name",)).alias("player_name"), _first("v", ("round_num",), "int").alias("round_number"), _first("v", ("score",), "double").alias("score"), *[_first("v", (c,), "double").alias(c) for c in SHOTS], _first("v", ("year",), "int").alias("year"), _first("v", ("fin_text",)).alias("finish_text"))
    return got.where(F.col("year") >= least_year)


def golf_results(rounds: DataFrame) -> DataFrame:
    """(tournament_id, player_id, player_name, year, total_score, rounds_played, sg_total_avg, finish_text, finish_position, made_cut) from golf_rounds; ties (T5) lose their letter, four rounds made the cut."""
    got = rounds.groupBy("tournament_id", "player_id", "player_name", "year").agg(F.sum("score").alias("total_score"), F.count("round_number").alias("rounds_played"), F.avg("sg_total").alias("sg_total_avg"), F.min_by("finish_text", "round_number").alias("finish_text"))
    place = F.regexp_extract(F.replace("finish_text", F.lit("T"), F.lit("")), r"(\d+)", 1).try_cast("double")
    return got.withColumn("finish_position", place).withColumn("made_cut", F.col("rounds_played") >= 4)


def golf_events(raw: DataFrame, json: str = "json") -> DataFrame:
    """(tournament_id, tournament_name, course_name, event_date, year, tour) of an event list; events without a day are dropped, the tour is `pga` unless named."""
    got = _records(raw, json).select(_first("v", ("event_id", "calendar_year")).alias("tournament_id"), F.coalesce(_first("v", ("event_name",)), F.lit("")).alias("tournament_name"), F.coalesce(_first("v", ("course", "course_name")), F.lit("")).alias("course_name"), day_of(_first("v", ("date", "start_date"))).alias("event_date"), _first("v", ("calendar_year", "year"), "int").alias("year"), F.coalesce(_first("v", ("tour",)), F.lit("pga")).alias("tour"))
    return got.where("event_date is not null")


def _renamed(df: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """df with each column renamed by the first rule that its lower-case name meets."""
    names = {}
    for c in df.columns:
        for new, fits in rules:
            if fits(c.lower().strip()):
                names.setdefault(new, c)
                break
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def constituents(raw: DataFrame) -> DataFrame:
    """(ticker, name, gics_sector, gics_subindustry, start_date, end_date, cik, notes) from a scraped table whose headers vary; ValueError if one is missing.

    An unreadable start is the index's first day; rows without a ticker are dropped.
    """
    df = _renamed(raw, [("ticker", lambda c: c in ("symbol", "ticker")), ("name", lambda c: "security" in c), ("gics_sector", lambda c: c == "gics sector"), ("gics_subindustry", lambda c: "gics sub" in c or "gics industry" in c), ("date_added", lambda c: "date added" in c or "date first added" in c), ("cik", lambda c: c == "cik")])
    require(df, ["ticker", "name", "gics_sector", "gics_subindustry", "date_added", "cik"])
    text = lambda c: F.trim(F.col(c).cast("string")).alias(c)
    start = F.coalesce(day_of(F.col("date_added").cast("string")), F.lit(INDEX_BEGAN).cast("date"))
    got = df.select(ticker_symbol(F.col("ticker")).alias("ticker"), text("name"), text("gics_sector"), text("gics_subindustry"), start.alias("start_date"), F.lit(None).cast("date").alias("end_date"), company_number(F.col("cik").cast("string")).alias("cik"), F.lit("current").alias("notes"))
    return got.where("ticker is not null and ticker <> ''")


CHANGES = ("event_date", "added_ticker", "added_name", "removed_ticker", "removed_name", "reason")


def change_events(raw: DataFrame, between: str = "|") -> DataFrame:
    """CHANGES from a table with two header levels, `top|bottom` in each name: a level that is empty or told twice counts once. Missing columns are null, rows without a day are dropped."""
    flat = {}
    for c in raw.columns:
        top, _, bottom = (x.strip().lower().replace(" ", "_") for x in c.partition(between))
        flat[c] = bottom if not top else top if not bottom or top == bottom else f"{top}_{bottom}"
    df = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in flat.items()])
    has = lambda *words: lambda c: all(any(w in c for w in word.split("/")) for word in words)
    df = _renamed(df, [("event_date", lambda c: "date" in c and "added" not in c and "removed" not in c), ("added_ticker", has("added", "ticker")), ("added_name", has("added", "security/name")), ("removed_ticker", has("removed", "ticker")), ("removed_name", has("removed", "security/name")), ("reason", has("reason"))])
    col = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    clean = {"event_date": day_of(col("event_date")), "added_ticker": F.coalesce(ticker_symbol(col("added_ticker")), F.lit("")), "removed_ticker": F.coalesce(ticker_symbol(col("removed_ticker")), F.lit(""))}
    return df.select(*[clean.get(c, F.coalesce(F.trim(col(c)), F.lit(""))).alias(c) for c in CHANGES]).where("event_date is not null")


def as_events(changes: DataFrame) -> DataFrame:
    """(ticker, d, kind, reason) of change events, for splits.membership."""
    both = F.array(F.struct(F.col("removed_ticker").alias("ticker"), F.lit("remove").alias("kind")), F.struct(F.col("added_ticker").alias("ticker"), F.lit("add").alias("kind")))
    return changes.select(F.col("event_date").alias("d"), "reason", F.explode(both).alias("e")).select("e.ticker", "d", "e.kind", "reason").where("ticker <> ''")


def log_games(raw: DataFrame, codes: dict[str, str], first: int) -> DataFrame:
    """Game logs (date as YYYYMMDD, home_team, visiting_team, scores, game_num) with sides by another source's codes, null where there is none, from season `first` on."""
    named = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    day = F.try_to_date(F.col("date").cast("string"), "yyyyMMdd")
    got = raw.select(day.alias("game_date"), F.year(day).alias("season"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"), "game_num", F.try_element_at(named, F.col("home_team")).alias("home"), F.try_element_at(named, F.col("visiting_team")).alias("away"), F.col("home_score").cast("int").alias("home_score"), F.col("visiting_score").cast("int").alias("away_score"))
    return got.withColumn("home_win", (F.col("home_score") > F.col("away_score")).cast("int")).withColumn("total", F.col("home_score") + F.col("away_score")).where(F.col("season") >= first)


def log_odds(raw: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Odds rows with sides by code, the day from the first eight digits, moneylines as numbers or null; rows without both closing lines are dropped."""
    named = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    lines = [F.col(c).cast("string").try_cast("double").alias(c) for c in ("home_open_ml", "away_open_ml", "home_close_ml", "away_close_ml")]
    got = raw.select("season", F.try_to_date(F.substring(F.col("date").cast("string"), 1, 8), "yyyyMMdd").alias("game_date"), F.try_element_at(named, F.col("home_team")).alias("home"), F.try_element_at(named, F.col("away_team")).alias("away"), *lines)
    return got.dropna(subset=["home_close_ml", "away_close_ml"])


def similar_names(names: DataFrame, least: float = 0.6, q: int = 2) -> DataFrame:
    """(a, b, similarity) of every two different names a < b whose sets of q letters, case and edges apart, have at least this Jaccard similarity.

    Names meet on rare pieces only: with its pieces in order of rarity, two names that are so alike share one among their first n - ceil(least n) + 1; what
    meets is verified exactly. Names equal but for case are one similarity of 1. Nulls are left out.
    """
    shown = names.select(F.col("name").alias("name")).where("name is not null").distinct()
    padded = F.concat(F.lit("^"), F.lower("name"), F.lit("$"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substr(padded, i, F.lit(q))))
    sets = shown.withColumn("_q", pieces)
    rows = sets.select("name", F.explode("_q").alias("piece"))
    counts = rows.groupBy("piece").agg(F.count("*").alias("k"))
    order = rows.join(counts, "piece").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda s: s["piece"]).alias("_o"))
    n = F.size("_o")
    keys = order.select("name", F.explode(F.slice("_o", 1, (n - F.ceil(least * n - 1e-9) + 1).cast("int"))).alias("piece"))
    left, right = keys.select(F.col("name").alias("a"), "piece"), keys.select(F.col("name").alias("b"), "piece")
    met = left.join(right, "piece").where("a < b").select("a", "b").distinct()
    both = met.join(sets.select(F.col("name").alias("a"), F.col("_q").alias("_a")), "a").join(sets.select(F.col("name").alias("b"), F.col("_q").alias("_b")), "b")
    similar = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    return both.select("a", "b", similar.alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def merge_checks(pairs: DataFrame, teams: DataFrame, covered: DataFrame) -> DataFrame:
    """pairs (current, former) with current_in_data, former_in_data, in_former_names and needs_merge: the former name is in the data and no list says whose it was."""
    known = lambda df, column, flag: df.select(F.col("name").alias(column)).distinct().withColumn(flag, F.lit(True))
    got = pairs.join(known(teams, "current", "current_in_data"), "current", "left").join(known(teams, "former", "former_in_data"), "former", "left").join(known(covered, "former", "in_former_names"), "former", "left")
    got = got.fillna(False, ["current_in_data", "former_in_data", "in_former_names"])
    return got.select("current", "former", "current_in_data", "former_in_data", "in_former_names", (F.col("former_in_data") & ~F.col("in_former_names")).alias("needs_merge"))
