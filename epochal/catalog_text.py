"""Queries on headers, labels, numbers and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import PARTS, SAMPLES, parts, query, read, sampled
from .functions import numbers, text, timespec
from .operators import channels as names

# Calibrations, rates, header texts, dates and labels made of the tables' columns.
KINDS = "(SELECT DISTINCT l_quantity AS q, CAST(round(l_discount * 100) AS INTEGER) AS disc, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_linenumber AS INTEGER) AS n FROM lineitem)"
CALIBRATION_SQL = f"(SELECT q, disc, tax, n, q - 25 AS pmin, CAST(disc * 10 - 20 AS DOUBLE) AS pmax, n * 100 - 300 AS dmin, tax * 100 - 300 AS dmax FROM {KINDS})"
STEP = "CASE WHEN dmax <> dmin THEN abs((pmax - pmin) / (dmax - dmin)) ELSE 0 END"


def kinds(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "lineitem").select(c("l_quantity").alias("q"), F.round(c("l_discount") * 100).cast("int").alias("disc"), F.round(c("l_tax") * 100).cast("int").alias("tax"), c("l_linenumber").cast("int").alias("n")).distinct()


def calibrations(spark, sf_dir):
    c = F.col
    return kinds(spark, sf_dir).select("q", "disc", "tax", "n", (c("q") - 25).alias("pmin"), (c("disc") * 10 - 20).cast("double").alias("pmax"), (c("n") * 100 - 300).alias("dmin"), (c("tax") * 100 - 300).alias("dmax"))


@query("SELECT rate, CAST(CASE WHEN len(tens) > 0 THEN greatest(3, list_min(tens)) ELSE least(15, greatest(3, ceil(log10(rate)) + 3)) END AS INTEGER) AS decimals FROM (SELECT rate, list_filter(range(0, 16), lambda d: pow(10.0::DOUBLE, d) / rate = floor(pow(10.0::DOUBLE, d) / rate)) AS tens FROM (SELECT DISTINCT q * n / 4 AS rate FROM " + KINDS + "))")
def time_decimals(spark, sf_dir):
    rates = kinds(spark, sf_dir).select((F.col("q") * F.col("n") / 4).alias("rate")).distinct()
    return rates.select("rate", numbers.time_decimals(F.col("rate")).alias("decimals"))


@query(f"SELECT q, disc, tax, n, {STEP} AS step, CAST(CASE WHEN {STEP} > 0 THEN least(100, greatest(0, ceil(-log10(CASE WHEN {STEP} > 0 THEN {STEP} END)) + 2)) ELSE 3 END AS INTEGER) AS decimals FROM {CALIBRATION_SQL}")
def derived_decimals(spark, sf_dir):
    step = numbers.quantization_step(*(F.col(c) for c in ("pmin", "pmax", "dmin", "dmax")))
    return calibrations(spark, sf_dir).select("q", "disc", "tax", "n", step.alias("step"), numbers.value_decimals(step).alias("decimals"))


@query(f"SELECT q, disc, tax, n, CASE WHEN dmax = dmin THEN 'DEGENERATE_DIGITAL_RANGE' WHEN pmax = pmin THEN 'DEGENERATE_PHYSICAL_RANGE' WHEN (pmax < pmin) <> (dmax < dmin) THEN 'INVERTED_PHYSICAL_RANGE' END AS fault FROM {CALIBRATION_SQL}")
def calibration_quality(spark, sf_dir):
    from .operators.diagnostics import calibration_fault

    df = calibrations(spark, sf_dir).withColumnsRenamed({"pmin": "physical_min", "pmax": "physical_max", "dmin": "digital_min", "dmax": "digital_max"})
    return df.select("q", "disc", "tax", "n", calibration_fault().alias("fault"))


FIELDS = "CASE l_linenumber % 7 WHEN 1 THEN l_partkey || '.5' WHEN 2 THEN l_partkey || ',25' WHEN 3 THEN ' -' || l_partkey || '.' WHEN 4 THEN '0x' || l_partkey WHEN 5 THEN l_partkey || 'e3' WHEN 6 THEN '+' || l_partkey || '.5,2' ELSE l_partkey || 'd' END"


@query("SELECT text, TRY_CAST(CASE WHEN regexp_matches(p, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN p END AS DOUBLE) AS number FROM (SELECT text, CASE WHEN contains(trim(text), '.') THEN trim(text) ELSE regexp_replace(trim(text), ',', '.') END AS p FROM (SELECT DISTINCT " + FIELDS + " AS text FROM lineitem))")
def header_number(spark, sf_dir):
    """Fields of headers: points, commas, signs, exponents, and what is no number."""
    texts = read(spark, sf_dir, "lineitem").select(F.expr(FIELDS).alias("text")).distinct()
    return texts.select("text", text.header_number(text.trim_field(F.col("text"))).alias("number"))


CLOCKS = "lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_custkey % 61 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 61 AS VARCHAR), 2, '0')"
DAYS = "CASE WHEN o_orderkey % 5 = 0 THEN '31' || {0}[3:8] WHEN o_orderkey % 5 = 1 THEN replace({0}, '.', '/') WHEN o_orderkey % 5 = 2 THEN {0}[2:8] ELSE {0} END".format("strftime(o_orderdate, '%d.%m.%y')")


@query("SELECT d, t, TRY_CAST(CASE WHEN regexp_matches(d, '^[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}$') AND regexp_matches(t, '^[0-9]{2}[.:-][0-9]{2}[.:-][0-9]{2}$') THEN (CASE WHEN d[7:8] >= '85' THEN '19' ELSE '20' END) || d[7:8] || '-' || d[4:5] || '-' || d[1:2] || ' ' || t[1:2] || ':' || t[4:5] || ':' || (CASE WHEN t[7:8] = '60' THEN '59' ELSE t[7:8] END) END AS TIMESTAMP) AS start_at FROM (SELECT DISTINCT " + DAYS + " AS d, " + CLOCKS + " AS t FROM orders)")
def start_datetime(spark, sf_dir):
    """Start dates and times of headers, some of which the calendar or the clock lacks."""
    day, key = F.date_format("o_orderdate", "dd.MM.yy"), F.col("o_orderkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    d = F.when(key % 5 == 0, F.concat(F.lit("31"), F.substring(day, 3, 6))).when(key % 5 == 1, F.replace(day, F.lit("."), F.lit("/"))).when(key % 5 == 2, F.substring(day, 2, 7)).otherwise(day)
    t = F.concat(two(key % 24), F.lit("."), two(F.col("o_custkey") % 61), F.lit(":"), two(key % 61))
    rows = read(spark, sf_dir, "orders").select(d.alias("d"), t.alias("t")).distinct()
    return rows.select("d", "t", text.start_datetime(F.col("d"), F.col("t")).alias("start_at"))


LABELS = "CASE p_partkey % 5 WHEN 0 THEN 'T8' WHEN 1 THEN 'T8_ch' || (p_partkey - 1) WHEN 2 THEN 'time_s' WHEN 3 THEN '' ELSE p_name END"
NAMED = "WITH b AS (SELECT p_brand AS path, p_partkey AS i, CASE WHEN label = '' THEN 'signal_' || p_partkey ELSE label END AS n0 FROM (SELECT *, " + LABELS + " AS label FROM part)), " + ", ".join(f"r{k} AS (SELECT path, i, n0, CASE WHEN count(*) OVER (PARTITION BY path, n{k - 1}) > 1 OR n{k - 1} = 'time_s' THEN n{k - 1} || '_ch' || i ELSE n{k - 1} END AS n{k} FROM {'b' if k == 1 else f'r{k - 1}'})" for k in (1, 2, 3, 4))


def labelled(spark, sf_dir):
    """Channels whose labels collide with each other, with suffixed names and with the time's."""
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("signal_index"), F.expr(LABELS).alias("label"))
    return names.column_names(rows)


@query(NAMED + " SELECT path, i AS signal_index, n4 AS column_name FROM r4")
def column_names_collision(spark, sf_dir):
    return labelled(spark, sf_dir).select("path", "signal_index", "column_name")


@query("SELECT label, distance FROM (SELECT p_name AS label, levenshtein(lower(p_name), 'blue anvl') AS distance FROM part GROUP BY 1) WHERE distance <= 3 ORDER BY distance, label LIMIT 3")
def label_suggest(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    return names.suggest(df, "blue anvl").select("label", F.col("distance").cast("long").alias("distance"))


@query("""SELECT path, CASE WHEN count(*) OVER (PARTITION BY path, label) > 1 THEN label || '_ch' || signal_index ELSE label END AS "column", signal_index, label, 'uV' AS unit, CAST(spr AS DOUBLE) AS sampling_rate_hz, spr AS samples_per_record, CAST(-price AS DOUBLE) AS physical_min, CAST(price AS DOUBLE) AS physical_max, -size AS digital_min, size AS digital_max, '' AS transducer, '' AS prefiltering, CASE WHEN spr > 0 THEN 'signals_' || spr ELSE '' END AS output_file, CASE WHEN spr > 0 THEN 'yes' ELSE 'no' END AS converted FROM (SELECT p_brand AS path, p_partkey AS signal_index, p_name AS label, p_size % 5 AS spr, p_size AS size, p_retailprice AS price FROM part)""")
def header_channels(spark, sf_dir):
    """The 14 columns that describe channels."""
    df, c = names.column_names(parts(spark, sf_dir)), F.col
    spr, price = c("samples_per_record"), c("p_retailprice").cast("double")
    return df.select("path", c("column_name").alias("column"), "signal_index", "label", F.lit("uV").alias("unit"), spr.cast("double").alias("sampling_rate_hz"), spr, (-price).alias("physical_min"), price.alias("physical_max"), (-c("p_size")).alias("digital_min"), c("p_size").alias("digital_max"), F.lit("").alias("transducer"), F.lit("").alias("prefiltering"), F.when(spr > 0, F.concat(F.lit("signals_"), spr)).otherwise("").alias("output_file"), F.when(spr > 0, "yes").otherwise("no").alias("converted"))


@query(f"SELECT path, count(DISTINCT spr) AS rates, max(spr) AS fastest FROM {PARTS} WHERE spr > 0 GROUP BY path")
def mixed_rates(spark, sf_dir):
    return parts(spark, sf_dir).where("samples_per_record > 0").groupBy("path").agg(F.count_distinct("samples_per_record").alias("rates"), F.max("samples_per_record").alias("fastest"))


@query(SAMPLES + "SELECT count(*) AS n FROM samples WHERE time_s >= 1e9 AND time_s < 2e9")
def empty_window(spark, sf_dir):
    from .recording import in_window

    return in_window(sampled(spark, sf_dir), 1e9, 2e9).agg(F.count(F.lit(1)).alias("n"))


@query(SAMPLES + "SELECT spr, count(*) // count(DISTINCT signal_index) AS n_rows, count(*) // count(DISTINCT signal_index) * (13 + 16 * count(DISTINCT signal_index)) AS bytes_at_most FROM samples GROUP BY spr")
def size_estimate(spark, sf_dir):
    """Rows and bytes of each table from metadata; the SQL counts samples."""
    from .recording import CHANNELS

    members: dict[int, int] = {}
    for c in CHANNELS:
        members[c[3]] = members.get(c[3], 0) + 1
    dims = F.lit(0)
    for spr, k in members.items():
        dims = F.when(F.col("spr") == spr, k).otherwise(dims)
    each = read(spark, sf_dir, "embeddings").select(F.explode(F.lit(list(members))).alias("spr")).groupBy("spr").agg(F.sum("spr").alias("n_rows"))
    return each.select("spr", "n_rows", (F.col("n_rows") * (13 + 16 * dims)).alias("bytes_at_most"))


@query("""SELECT count(*) AS n, sum(CASE WHEN regexp_matches(text, '^[=+@]') OR (starts_with(text, '-') AND length(text) > 1 AND NOT regexp_matches(text, '^-([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 1 ELSE 0 END) AS formulas, sum(CASE WHEN regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{9f}]') THEN 1 ELSE 0 END) AS controls, sum(CASE WHEN contains(text, ',') THEN 1 ELSE 0 END) AS commas, sum(CASE WHEN contains(text, '"') THEN 1 ELSE 0 END) AS quotes FROM documents""")
def quality_text(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.starts_formula(t)).alias("formulas"), F.count_if(text.has_control(t)).alias("controls"), F.count_if(t.contains(",")).alias("commas"), F.count_if(t.contains('"')).alias("quotes"))


@query("SELECT event_id, CAST(record AS DOUBLE) AS onset_s, part AS description FROM (SELECT event_id, event_id % 1000 + 0.5 AS record, unnest(string_split(event_type || '/' || user_id, '/')) AS part FROM events)")
def tal_decode(spark, sf_dir):
    """Events written as annotation lists, then read back through the decoder."""
    from .operators.annotations import events

    onset = F.concat(F.lit("+"), F.col("event_id") % 1000, F.lit(".5\x14"))
    made = F.concat(onset, "event_type", F.lit("\x14"), F.col("user_id").cast("string"), F.lit("\x14\x00"))
    slots = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit(0).cast("long").alias("record_index"), F.lit(0).alias("signal_index"), F.lit(False).alias("timekeeping"), F.encode(made, "UTF-8").alias("slot"))
    return events(slots).select(F.col("path").cast("long").alias("event_id"), "onset_s", "description")


@query("SELECT doc_id, text AS decoded FROM documents UNION ALL SELECT -doc_id - 1, 'é' || lang FROM documents")
def text_decode(spark, sf_dir):
    """Valid UTF-8 as it is, and Latin-1 bytes that are no UTF-8."""
    docs = read(spark, sf_dir, "documents")
    latin = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.encode(F.concat(F.lit("é"), "lang"), "ISO-8859-1").alias("raw"))
    both = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).unionByName(latin)
    return both.select("doc_id", text.decode_text(F.col("raw")).alias("decoded"))


@query("SELECT k, CASE WHEN k < 0 AND abs(k) * 125 + 5 >= 10 THEN '-' ELSE '' END || ((abs(k) * 125 + 5) // 1000) || '.' || lpad(CAST(((abs(k) * 125 + 5) % 1000) // 10 AS VARCHAR), 2, '0') AS printed FROM (SELECT DISTINCT l_partkey - l_suppkey * 3 AS k FROM lineitem)")
def fixed_text(spark, sf_dir):
    """Eighths to two places: ties go away from zero."""
    k = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") - F.col("l_suppkey") * 3).alias("k")).distinct()
    return k.select("k", numbers.fixed_text(F.col("k") / 8.0, F.lit(2)).alias("printed"))


@query("SELECT DISTINCT l_extendedprice AS price, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS printed, regexp_replace(CAST(l_extendedprice / 8 AS VARCHAR), '\\.0$', '') AS eighth FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem)")
def number_text(spark, sf_dir):
    price = F.col("l_extendedprice").cast("double")
    return read(spark, sf_dir, "lineitem").select(price.alias("price")).distinct().select("price", numbers.shortest_text(F.col("price")).alias("printed"), numbers.shortest_text(F.col("price") / 8).alias("eighth"))


PRINTED = "CASE WHEN rate = floor(rate) THEN CAST(CAST(rate AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', rate), '\\.?0+$', '') END"


@query(f"SELECT n, rate, {PRINTED} AS printed, replace({PRINTED}, '.', '_') || 'hz' AS slug FROM (SELECT DISTINCT n, q / n AS rate FROM {KINDS})")
def rate_text(spark, sf_dir):
    """Rates of a recording as text and in the names of tables, told apart within it."""
    printed = F.pandas_udf(lambda rates: rates.map(lambda r: numbers.rate_texts([float(x) for x in r])), "array<string>")
    slugs = F.pandas_udf(lambda rates: rates.map(lambda r: numbers.rate_slugs([float(x) for x in r])), "array<string>")
    rates = kinds(spark, sf_dir).groupBy("n").agg(F.collect_set(F.col("q") / F.col("n")).alias("rate"))
    rows = rates.select("n", F.explode(F.arrays_zip("rate", printed("rate").alias("printed"), slugs("rate").alias("slug"))).alias("r"))
    return rows.select("n", "r.rate", "r.printed", "r.slug")


SPECS = "CASE l_linenumber % 7 WHEN 1 THEN '' || l_partkey WHEN 2 THEN q || 'm' || l_linenumber || 's' WHEN 3 THEN q || ':' || l_suppkey % 100 WHEN 4 THEN l_partkey || 'h ' || q || 'm ' || l_linenumber || 's' WHEN 5 THEN '-' || l_partkey || ':' || q || ':' || l_suppkey % 70 || '.5' WHEN 6 THEN l_partkey || ' min' ELSE l_partkey || 'ms' END"


@query("SELECT spec, CASE WHEN regexp_matches(body, '^[0-9]+(\\.[0-9]+)?$') THEN sign * CAST(body AS DOUBLE) WHEN regexp_matches(body, '^([0-9]+:)?[0-9]{1,2}:[0-9]{1,2}(\\.[0-9]+)?$') THEN CASE WHEN CAST(parts[-2] AS INTEGER) < 60 AND CAST(parts[-1] AS DOUBLE) < 60 THEN sign * (CASE WHEN len(parts) = 3 THEN CAST(parts[1] AS DOUBLE) * 3600 ELSE 0 END + CAST(parts[-2] AS DOUBLE) * 60 + CAST(parts[-1] AS DOUBLE)) END WHEN regexp_matches(body, '^([0-9]+h ?)?([0-9]+m ?)?([0-9]+s)?$') AND body <> '' THEN sign * (3600 * coalesce(TRY_CAST(regexp_extract(body, '([0-9]+)h', 1) AS DOUBLE), 0) + 60 * coalesce(TRY_CAST(regexp_extract(body, '([0-9]+)m', 1) AS DOUBLE), 0) + coalesce(TRY_CAST(regexp_extract(body, '([0-9]+)s$', 1) AS DOUBLE), 0)) WHEN regexp_matches(body, '^[0-9]+ms$') THEN sign * (CAST(body[:-3] AS DOUBLE) * CAST(0.001 AS DOUBLE)) END AS seconds FROM (SELECT spec, CASE WHEN starts_with(spec, '-') THEN spec[2:] ELSE spec END AS body, CASE WHEN starts_with(spec, '-') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, string_split(CASE WHEN starts_with(spec, '-') THEN spec[2:] ELSE spec END, ':') AS parts FROM (SELECT DISTINCT " + SPECS + " AS spec FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)))")
def time_specs(spark, sf_dir):
    """Times as people write them, some of which are none."""

    def read_spec(x):
        try:
            return timespec.seconds_of(x)
        except timespec.TimeSpecError:
            return None

    seconds = F.pandas_udf(lambda specs: specs.map(read_spec).astype("float64"), "double")
    rows = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")).select(F.expr(SPECS).alias("spec")).distinct()
    return rows.select("spec", F.nanvl(seconds("spec"), F.lit(None)).alias("seconds"))


HEADS = "SELECT DISTINCT strftime(CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%d.%m.%y') AS d, CASE WHEN o_orderkey % 4 = 2 THEN 'X' ELSE 'Startdate ' || strftime(o_orderdate, '%d-%b-') || (year(o_orderdate) - CASE WHEN o_orderkey % 4 = 3 THEN 100 ELSE 0 END) END AS id FROM orders"


@query(f"SELECT d, id, TRY_CAST((CASE WHEN same THEN y ELSE (CASE WHEN d[7:8] >= '85' THEN '19' ELSE '20' END) || d[7:8] END) || '-' || d[4:5] || '-' || d[1:2] || ' 05:06:07' AS TIMESTAMP) AS start_at, id <> 'X' AND NOT same AS mismatch FROM (SELECT *, id <> 'X' AND dd = d[1:2] AND mo = CAST(d[4:5] AS INTEGER) AND y[3:4] = d[7:8] AS same FROM (SELECT d, id, (instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', upper(id[14:16])) + 2) // 3 AS mo, id[11:12] AS dd, id[18:21] AS y FROM ({HEADS})))")
def stated_dates(spark, sf_dir):
    """The century from the recording field, and dates that contradict each other."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    d = F.date_format(F.when(key % 4 == 1, day + F.expr("INTERVAL 1 DAY")).otherwise(day), "dd.MM.yy")
    year = F.year(day) - F.when(key % 4 == 3, 100).otherwise(0)
    id = F.when(key % 4 == 2, "X").otherwise(F.concat(F.lit("Startdate "), F.date_format(day, "dd-MMM-"), year))
    df = read(spark, sf_dir, "orders").select(d.alias("d"), id.alias("id")).distinct()
    return df.select("d", "id", text.start_datetime(F.col("d"), F.lit("05.06.07"), F.col("id")).alias("start_at"), text.date_mismatch(F.col("d"), F.col("id")).alias("mismatch"))


@query("SELECT doc_id, replace(replace(text, chr(10), '\\x0a'), chr(9), '\\x09') AS shown FROM documents")
def printable_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.printable(F.col("text")).alias("shown"))


@query(f"SELECT q, disc, tax, n, length(printf('%.3f', greatest(abs(pmin), abs(pmax)))) + CASE WHEN pmin < 0 OR pmax < 0 THEN 1 ELSE 0 END AS width, abs(pmin - pmax) <= greatest(abs(pmin), abs(pmax)) * 1e-12 AS equal, 1e16 + abs(pmax) > 1e16 AS carried FROM {CALIBRATION_SQL}")
def cell_width(spark, sf_dir):
    df, c = calibrations(spark, sf_dir), F.col
    return df.select("q", "disc", "tax", "n", numbers.cell_width(F.greatest(F.abs("pmin"), F.abs("pmax")), F.lit(3), (c("pmin") < 0) | (c("pmax") < 0)).alias("width"), numbers.nearly_equal(c("pmin"), c("pmax")).alias("equal"), numbers.can_carry(F.lit(1e16), F.abs("pmax")).alias("carried"))


@query(NAMED + " SELECT path, i AS signal_index, n4 AS column_name FROM (SELECT *, count(*) OVER (PARTITION BY path, n0) AS own FROM r4) WHERE own = 1 AND n4 <> n0")
def renamed_channels(spark, sf_dir):
    """Channels whose own name another column has taken."""
    return names.renamed(labelled(spark, sf_dir)).select("path", "signal_index", "column_name")
