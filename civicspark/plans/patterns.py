"""Reusable relational patterns, joins, windows and scalar functions as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import apportion as ap
from civicspark.operators import candidates as cd
from civicspark.operators import enrich, grouping, reshape
from civicspark.plans.apportionment import AVG_RANK, CONSTITUENCY_WON
from civicspark.plans.elections import constituency_seats
from civicspark.plans.levelling import TOTALS, election
from civicspark.plans.registry import query
from civicspark.plans.tables import EP_SEATS

PARTIES = [f"Brand#{i}" for i in range(1, 26)]
KEYS = ["election_id"]

# ---- ranks and group picks ------------------------------------------------------------

PRICE_BAND = "CAST(floor(o_totalprice / 500) AS BIGINT)"


def priced_orders(t):
    """Orders with a price band, so that ranks have ties."""
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderpriority").alias("priority"),
        F.floor(F.col("o_totalprice") / 500).alias("band"),
    )


@query("avg_rank", f"""
SELECT o_orderkey AS order_id, o_orderpriority AS priority, {PRICE_BAND} AS band,
       (rank() OVER w + (count(*) OVER t - 1) / 2.0)::DOUBLE AS avg_rank FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY {PRICE_BAND} DESC),
       t AS (PARTITION BY o_orderpriority, {PRICE_BAND})""")
def avg_rank(t):
    ranked = grouping.split_rank(priced_orders(t), ["priority"], "band")
    return ranked.select("order_id", "priority", "band", F.col("rank_avg").alias("avg_rank"))


@query("rank_family", f"""
SELECT o_orderkey AS order_id, dense_rank() OVER w AS dense, rank() OVER w AS low,
       row_number() OVER (PARTITION BY o_custkey ORDER BY {PRICE_BAND} DESC, o_orderkey) AS nth
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY {PRICE_BAND} DESC)""")
def rank_family(t):
    ranked = grouping.split_rank(priced_orders(t), ["priority"], "band").select(
        "order_id", F.col("rank_dense").alias("dense"), F.col("rank_min").alias("low")
    )
    numbered = grouping.split_row_number(
        t("orders").select(
            F.col("o_orderkey").alias("order_id"),
            "o_custkey",
            F.floor(F.col("o_totalprice") / 500).alias("band"),
        ),
        ["o_custkey"], "band", "order_id", "nth",
    )
    return ranked.join(numbered.select("order_id", "nth"), "order_id")


@query("group_max_rows", f"""
SELECT order_id, priority, band FROM (
  SELECT o_orderkey AS order_id, o_orderpriority AS priority, {PRICE_BAND} AS band,
         max({PRICE_BAND}) OVER (PARTITION BY o_orderpriority) AS top FROM orders) WHERE band = top""")
def group_max_rows(t):
    return grouping.group_max_rows(priced_orders(t), ["priority"], "band")


@query("topk_per_group", f"""
SELECT * FROM (SELECT o_orderkey AS order_id, o_orderpriority AS priority, {PRICE_BAND} AS band,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY {PRICE_BAND} DESC, o_orderkey)::INT AS rank
       FROM orders) WHERE rank <= 10""")
def topk_per_group(t):
    return grouping.topk_per_group(priced_orders(t), ["priority"], "band", 10, ["order_id"])


@query("first_per_key", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_per_key(t):
    events = t("events").select("user_id", "ts", "event_id", "event_type")
    return grouping.first_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("duplicate_flag", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS again FROM events""")
def duplicate_flag(t):
    events = t("events").select("event_id", "user_id", "event_type")
    return grouping.duplicate_flag(events, ["user_id", "event_type"], "event_id", "again").select(
        "event_id", "again"
    )


# ---- patches, fills, repeats ------------------------------------------------------------


@query("patch_nulls", """
SELECT match_id, coalesce(m.city, s.city) AS city
FROM fx_matches m LEFT JOIN (SELECT 'Stadium' || s_suppkey AS stadium, s_name AS city FROM supplier) s
  USING (stadium)""")
def patch_nulls(t):
    lookup = t("supplier").select(
        F.concat(F.lit("Stadium"), F.col("s_suppkey").cast("string")).alias("stadium"),
        F.col("s_name").alias("city"),
    )
    return enrich.patch_nulls(t.matches(), lookup, ["stadium"], ["city"]).select("match_id", "city")


@query("update_rows", """
SELECT match_id, CASE WHEN s.stadium IS NOT NULL THEN s.city ELSE m.city END AS city
FROM fx_matches m LEFT JOIN (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'Stadium' ELSE 'Ground' END || s_suppkey AS stadium,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS city FROM supplier) s
  USING (stadium)""")
def update_rows(t):
    key = F.col("s_suppkey")
    kind = F.when(key % 2 == 0, "Stadium").otherwise("Ground")
    patch = t("supplier").select(
        F.concat(kind, key.cast("string")).alias("stadium"),
        F.when(key % 3 != 0, F.col("s_name")).alias("city"),
    )
    return enrich.update_rows(t.matches(), patch, ["stadium"], ["city"]).select("match_id", "city")


@query("locf", """
SELECT match_id, last_value(city IGNORE NULLS) OVER (PARTITION BY league ORDER BY kickoff, match_id) AS city
FROM (SELECT *  REPLACE (CASE WHEN match_id % 5 = 0 THEN city END AS city) FROM fx_matches)""")
def locf(t):
    sparse = t.matches().withColumn("city", F.when(F.col("match_id") % 5 == 0, F.col("city")))
    filled = enrich.locf(sparse, ["league"], "kickoff", ["city"], ["match_id"])
    return filled.select("match_id", "city")


@query("repeat_rows", """
SELECT p_partkey AS part_id, i::INT AS nth FROM part, generate_series(1, 50) g(i) WHERE i <= p_size""")
def repeat_rows(t):
    parts = t("part").select(F.col("p_partkey").alias("part_id"), "p_size")
    return reshape.repeat_rows(parts, F.col("p_size"), "nth").drop("p_size")


# ---- report tables -------------------------------------------------------------------------

ALONE = f"""
nq AS (SELECT *, votes / d::DOUBLE AS quotient FROM fx_national_votes, generate_series(1, {EP_SEATS}) x(d)),
nr AS (SELECT *, {AVG_RANK} AS rk FROM nq
       WINDOW w AS (PARTITION BY election_id ORDER BY quotient DESC),
              t AS (PARTITION BY election_id, quotient))
"""


def national_quotients(t):
    return ap.highest_averages(
        t.national_votes(), KEYS, "party", "votes", EP_SEATS, prune=False, detail=True
    )


@query("quotient_matrix", f"""
WITH {ALONE}
SELECT election_id, d::INT AS divisor,
       {", ".join(f"max(CASE WHEN party = '{p}' THEN quotient END) AS {chr(34)}{p}{chr(34)}" for p in PARTIES)}
FROM nr GROUP BY 1, 2""")
def quotient_matrix(t):
    return reshape.quotient_matrix(
        national_quotients(t), ["election_id", "divisor"], "party", "quotient", PARTIES
    )


@query("winning_cells", f"""
WITH {ALONE},
c AS (SELECT *, dense_rank() OVER (PARTITION BY election_id ORDER BY party) AS col FROM nr)
SELECT election_id, (d - 1)::INT AS row, col::INT AS col FROM c WHERE rk <= {EP_SEATS}""")
def winning_cells(t):
    # number the columns on the parties, then keep the cells long
    votes = t.national_votes()
    columns = votes.withColumn(
        "col", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("party"))
    )
    cells = ap.highest_averages(columns, KEYS, "party", "votes", EP_SEATS, detail=True)
    return reshape.winning_cells(cells, F.col("divisor") - 1, F.col("col")).select(
        "election_id", "row", "col"
    )


@query("marked_quotients", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")}
SELECT election_id, constituency_id, party, d::INT AS divisor,
       CASE WHEN rk <= seats THEN '(' || replace(rk::DOUBLE::VARCHAR, '.0', '') || ') ' ELSE '' END
         || quotient::BIGINT::VARCHAR AS cell FROM cr""")
def marked_quotients(t):
    cells = ap.highest_averages(
        t.party_votes().join(t.seats().select("constituency_id", "seats"), "constituency_id"),
        ["election_id", "constituency_id"], "party", "votes", "seats",
        round_quotient=True, detail=True, divisors="seats",
    )
    text = reshape.marked_quotient(
        F.col("won"), cd.rank_text(F.col("rank")), F.col("quotient").cast("bigint").cast("string")
    )
    return cells.select("election_id", "constituency_id", "party", "divisor", text.alias("cell"))


@query("quotient_tables", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")},
c AS (SELECT election_id, constituency_id, party, d::INT AS divisor,
             CASE WHEN rk <= seats THEN '(' || replace(rk::DOUBLE::VARCHAR, '.0', '') || ') ' ELSE '' END
               || quotient::BIGINT::VARCHAR AS cell FROM cr),
l AS (SELECT election_id, constituency_id, divisor, map(list(party ORDER BY party), list(cell ORDER BY party)) AS cells
      FROM c GROUP BY 1, 2, 3)
SELECT election_id, constituency_id, count(*)::INT AS n_rows,
       CAST(to_json(list({{'divisor': divisor, 'cells': cells}} ORDER BY divisor)) AS VARCHAR) AS rows
FROM l GROUP BY 1, 2""")
def quotient_tables(t):
    """One quotient table per constituency with the parties that stand there, as JSON text."""
    nested = reshape.nested_matrix(marked_quotients(t), ["election_id", "constituency_id"], "divisor", "party", "cell")
    return nested.withColumn("n_rows", F.size("rows")).withColumn("rows", F.to_json("rows"))


@query("nest_unnest", """
SELECT election_id, constituency_id, party, votes, count(*) OVER (PARTITION BY election_id, constituency_id)::INT AS n
FROM fx_party_votes""")
def nest_unnest(t):
    votes = t.party_votes("election_id", "constituency_id", "party")
    nested = reshape.nest(votes, ["election_id", "constituency_id"], "parties")
    return reshape.unnest(nested.withColumn("n", F.size("parties")), "parties")


@query("totals_row", f"""
WITH {CONSTITUENCY_WON.format(votes="fx_party_votes")}
SELECT election_id, coalesce(party, 'I alt') AS party, sum(votes)::BIGINT AS votes, sum(won)::BIGINT AS seats
FROM cwon GROUP BY GROUPING SETS ((election_id, party), (election_id))""")
def totals_row(t):
    won = constituency_seats(t.party_votes(), t.seats())
    return reshape.totals_row(won, "party", "I alt", {"votes": "votes", "seats": "won"}, KEYS)


@query("report_totals", f"""
WITH {TOTALS}
SELECT election_id, coalesce(party, 'I alt') AS party, sum(levelling_seats + constituency_seats)::BIGINT AS total_seats,
       sum(constituency_seats)::BIGINT AS constituency_seats, sum(levelling_seats)::BIGINT AS levelling_seats
FROM tot GROUP BY GROUPING SETS ((election_id, party), (election_id))""")
def report_totals(t):
    """Seats in all, in constituencies and to level out per party, and one line for all of them."""
    return election(t).result_table.select(*KEYS, "party", "total_seats", "constituency_seats", "levelling_seats")


@query("alliance_members", """
SELECT coalesce(alliance, 'none') AS alliance, string_agg(party, ', ' ORDER BY party) AS members,
       count(*)::INT AS n_members,
       coalesce(alliance, 'none') || ': ' || string_agg(party, ', ' ORDER BY party) AS line
FROM fx_party GROUP BY 1""")
def alliance_members(t):
    parties = t.parties().withColumn("alliance", F.coalesce("alliance", F.lit("none")))
    lines = reshape.member_text(parties, ["alliance"], "party")
    return lines.withColumn("line", F.concat_ws(": ", "alliance", "members"))


@query("alliance_lines", """
WITH g AS (SELECT coalesce(alliance, 'none') AS alliance, string_agg(party, ', ' ORDER BY party) AS members
           FROM fx_party GROUP BY 1)
SELECT string_agg(alliance || ': ' || members, '<br>' ORDER BY alliance) AS lines FROM g""")
def alliance_lines(t):
    parties = t.parties().withColumn("alliance", F.coalesce("alliance", F.lit("none")))
    members = reshape.member_text(parties, ["alliance"], "party")
    return reshape.group_lines(members, "alliance", "members")


@query("alliance_size", """
SELECT alliance, count(DISTINCT p_brand) AS parties FROM part JOIN fx_party ON party = p_brand GROUP BY 1""")
def alliance_size(t):
    # distinct first: the parts of one party collapse before the shuffle
    return t.parties().groupBy("alliance").agg(F.countDistinct("party").alias("parties"))


@query("custom_sort", """
SELECT c_custkey AS id, c_mktsegment AS segment,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS sort_key FROM customer""")
def custom_sort(t):
    key = reshape.selected_first(F.col("segment"), ["MACHINERY", "BUILDING"]).cast("int")
    return (
        t("customer")
        .select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
        .withColumn("sort_key", key)
        .orderBy("sort_key", "segment", "id")
    )


DANISH_HEADS = ("Aa", "Å", "Æ", "Ø", "Z")


@query("danish_sort", f"""
WITH n AS (SELECT {list(DANISH_HEADS)}[c_custkey % 5 + 1] || c_name AS name FROM customer)
SELECT name, row_number() OVER (ORDER BY name COLLATE da, name) AS place FROM n""")
def danish_sort(t):
    heads = F.array(*[F.lit(h) for h in DANISH_HEADS])
    head = F.element_at(heads, (F.col("c_custkey") % 5 + 1).cast("int"))
    named = t("customer").select(F.concat(head, "c_name").alias("name"))
    order = [reshape.danish_order(F.col("name")), F.col("name")]
    return grouping.split_row_order(named, order, "place").orderBy("place")


@query("stacked_grains", """
SELECT NULL::INT AS constituency_id, region_id, sum(votes)::BIGINT AS votes FROM fx_party_votes GROUP BY 2
UNION ALL SELECT constituency_id, NULL, sum(votes)::BIGINT FROM fx_party_votes GROUP BY 1""")
def stacked_grains(t):
    t = t.counted()
    regions = t.party_votes("region_id")
    constituencies = t.party_votes("constituency_id")
    return regions.unionByName(constituencies, allowMissingColumns=True)


@query("add_row", """
SELECT * FROM fx_national_votes UNION ALL
SELECT election_id, 'blank', 0::BIGINT FROM (SELECT DISTINCT election_id FROM fx_national_votes)""")
def add_row(t):
    votes = t.counted().national_votes()
    blank = votes.select("election_id", F.lit("blank").alias("party"), F.lit(0).cast("bigint").alias("votes"))
    return votes.unionByName(blank.distinct())


# ---- verbs ----------------------------------------------------------------------------------


@query("cast_many", """
SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity::BIGINT AS quantity,
       l_discount::VARCHAR AS discount_text, l_tax > 0.04 AS taxed,
       try_cast(replace(l_returnflag, 'R', '1') AS INT) AS flag FROM lineitem""")
def cast_many(t):
    casts = {
        "quantity": F.col("l_quantity").cast("bigint"),
        "discount_text": F.col("l_discount").cast("string"),
        "taxed": F.col("l_tax") > 0.04,
        "flag": tx.whole_number(F.replace("l_returnflag", F.lit("R"), F.lit("1"))).cast("int"),
    }
    return (
        t("lineitem")
        .withColumns(casts)
        .select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), *casts
        )
    )


@query("filter_predicates", """
SELECT event_id FROM events
WHERE (event_type IN ('click', 'view') AND value > 5 OR user_id < 20 AND NOT event_type = 'error')
  AND value IS NOT NULL""")
def filter_predicates(t):
    kind, user = F.col("event_type"), F.col("user_id")
    wanted = (kind.isin("click", "view") & (F.col("value") > 5)) | ((user < 20) & ~(kind == "error"))
    return t("events").where(wanted & F.col("value").isNotNull()).select("event_id")


@query("agg_family", """
SELECT event_type, sum(user_id)::BIGINT AS total, max(value) AS top, min(value) AS low, count(*) AS n,
       count(*) FILTER (WHERE value > 10) AS n_over FROM events GROUP BY 1""")
def agg_family(t):
    return t("events").groupBy("event_type").agg(
        F.sum("user_id").alias("total"),
        F.max("value").alias("top"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") > 10).alias("n_over"),
    )


@query("setdiff_parties", """
SELECT DISTINCT p_brand AS party FROM part
EXCEPT SELECT CASE WHEN ordered_list THEN party ELSE party || ' open' END FROM fx_party""")
def setdiff_parties(t):
    parties = t("part").select(F.col("p_brand").alias("party")).distinct()
    # open lists go by a name that no part has
    name = F.when(F.col("ordered_list"), F.col("party")).otherwise(F.concat("party", F.lit(" open")))
    ordered = t.parties().select(name.alias("party"))
    return parties.join(ordered, "party", "left_anti")


@query("scalar_as_column", """
SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY 1""")
def scalar_as_column(t):
    counts = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return reshape.scalar_column(counts, "total", t("events").agg(F.count(F.lit(1))))


# ---- joins -----------------------------------------------------------------------------------


def customer_key(held):
    """The customer of orders that hold a condition, and a key that no customer has for the others."""
    return F.when(held, F.col("o_custkey")).otherwise(-1 - F.col("o_custkey"))


@query("join_inner", """
SELECT l_orderkey AS order_id, l_linenumber AS line, o_custkey AS customer_id
FROM lineitem JOIN orders ON l_orderkey = CASE o_orderstatus WHEN 'F' THEN o_orderkey ELSE -1 - o_orderkey END""")
def join_inner(t):
    # orders that are not closed have keys that no line has
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey"))
    closed = t("orders").select(key.alias("closed_key"), "o_custkey")
    return (
        t("lineitem")
        .join(closed, F.col("l_orderkey") == F.col("closed_key"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("o_custkey").alias("customer_id"),
        )
    )


@query("join_left", """
SELECT c_custkey AS customer_id, o_orderkey AS order_id
FROM customer LEFT JOIN orders ON c_custkey = CASE WHEN o_totalprice > 200000 THEN o_custkey ELSE -1 - o_custkey END""")
def join_left(t):
    large = t("orders").select(customer_key(F.col("o_totalprice") > 200000).alias("large_key"), "o_orderkey")
    return (
        t("customer")
        .join(large, F.col("c_custkey") == F.col("large_key"), "left")
        .select(F.col("c_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"))
    )


@query("join_semi", """
SELECT c_custkey AS customer_id FROM customer WHERE EXISTS (
  SELECT 1 FROM orders WHERE c_custkey = CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey ELSE -1 - o_custkey END)""")
def join_semi(t):
    # distinct keys first, so a customer with very many orders sends one row
    key = customer_key(F.col("o_orderpriority") == "1-URGENT")
    urgent = t("orders").select(key.alias("customer_id")).distinct()
    customers = t("customer").select(F.col("c_custkey").alias("customer_id"))
    return customers.join(urgent, "customer_id", "left_semi")


@query("join_anti", """
SELECT c_custkey AS customer_id FROM customer WHERE c_custkey NOT IN (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey ELSE -1 - o_custkey END FROM orders)""")
def join_anti(t):
    key = customer_key(F.col("o_orderpriority") == "1-URGENT")
    urgent = t("orders").select(key.alias("customer_id")).distinct()
    customers = t("customer").select(F.col("c_custkey").alias("customer_id"))
    return customers.join(urgent, "customer_id", "left_anti")


@query("join_cross", """
SELECT election_id, kind, d::INT AS divisor
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS election_id FROM orders),
     (VALUES ('valgaften'), ('fintælling')) k(kind), generate_series(1, 14) g(d)""")
def join_cross(t):
    years = t("orders").select(F.year("o_orderdate").alias("election_id")).distinct()
    kinds = F.array(F.lit("valgaften"), F.lit("fintælling"))
    return years.withColumn("kind", F.explode(kinds)).withColumn(
        "divisor", F.explode(F.sequence(F.lit(1), F.lit(14)))
    )


@query("join_nullsafe", """
WITH s AS (SELECT alliance, count(*) AS size FROM fx_party GROUP BY 1)
SELECT p.party, p.alliance, size FROM fx_party p JOIN s ON p.alliance IS NOT DISTINCT FROM s.alliance""")
def join_nullsafe(t):
    parties = t.parties().select("party", "alliance")
    sizes = parties.groupBy("alliance").agg(F.count(F.lit(1)).alias("size"))
    return grouping.null_safe_join(parties, sizes, ["alliance"])


@query("window_broadcast", """
SELECT o_orderkey AS order_id, count(*) OVER w AS n, min(o_orderdate) OVER w AS first_day,
       max(o_totalprice) OVER w AS top
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def window_broadcast(t):
    orders = t("orders").select(
        F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate", "o_totalprice"
    )
    stats = grouping.with_group_stats(
        orders, ["o_custkey"], n=F.count(F.lit(1)), first_day=F.min("o_orderdate"),
        top=F.max("o_totalprice"),
    )
    return stats.select("order_id", "n", "first_day", "top")


# ---- scalar functions --------------------------------------------------------------------------


@query("fn_conditional", """
SELECT event_id, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'mid' ELSE 'low' END AS level,
       coalesce(nullif(event_type, 'error'), 'none') AS kind,
       CASE event_type WHEN 'view' THEN 'look' ELSE event_type END AS recoded FROM events""")
def fn_conditional(t):
    value, kind = F.col("value"), F.col("event_type")
    return t("events").select(
        "event_id",
        F.when(value > 20, "high").when(value > 5, "mid").otherwise("low").alias("level"),
        F.coalesce(F.nullif(kind, F.lit("error")), F.lit("none")).alias("kind"),
        enrich.value_recode(kind, {"view": "look"}).alias("recoded"),
    )


@query("fn_rounding", """
SELECT event_id, floor(value)::BIGINT AS whole, round_even(value * 2, 0) / 2 AS half_even,
       round((event_id % 7)::DOUBLE / 2, 0) AS half_up FROM events""")
def fn_rounding(t):
    return t("events").select(
        "event_id",
        F.floor("value").alias("whole"),
        (F.bround(F.col("value") * 2, 0) / 2).alias("half_even"),
        F.round((F.col("event_id") % 7).cast("double") / 2, 0).alias("half_up"),
    )


@query("fn_match", """
SELECT event_id, regexp_matches(event_type, '^[cp]') AS hit, NOT regexp_matches(event_type, 'o') AS miss,
       nullif(regexp_extract(props, '[0-9]+'), '') AS digits, event_type IN ('click', 'error') AS listed
FROM events""")
def fn_match(t):
    kind = F.col("event_type")
    return t("events").select(
        "event_id",
        kind.rlike("^[cp]").alias("hit"),
        (~kind.rlike("o")).alias("miss"),
        F.regexp_substr("props", F.lit("[0-9]+")).alias("digits"),
        kind.isin("click", "error").alias("listed"),
    )


@query("fn_string", """
SELECT c_custkey AS id, replace(c_name, '#', '') AS stripped, lower(c_mktsegment) AS low,
       right(c_name, 3) AS tail, trim('  ' || c_mktsegment || ' ') AS trimmed,
       upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-' || 'Nicolas' AS title FROM customer""")
def fn_string(t):
    segment = F.col("c_mktsegment")
    return t("customer").select(
        F.col("c_custkey").alias("id"),
        F.regexp_replace("c_name", "#", "").alias("stripped"),
        F.lower(segment).alias("low"),
        F.right("c_name", F.lit(3)).alias("tail"),
        F.trim(F.concat(F.lit("  "), segment, F.lit(" "))).alias("trimmed"),
        tx.title_case(F.concat(segment, F.lit("-NICOLAS"))).alias("title"),
    )


@query("fn_split_join", """
SELECT c_custkey AS id, len(string_split(c_mktsegment, '')) AS letters, split_part(c_name, '#', 1) AS head,
       c_name || CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '!' END AS joined,
       concat_ws('-', c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'x' END) AS joined_ws,
       'no ' || c_custkey || ': ' || c_name AS line FROM customer""")
def fn_split_join(t):
    some = F.col("c_custkey") % 4 != 0
    return t("customer").select(
        F.col("c_custkey").alias("id"),
        F.size(F.split("c_mktsegment", "")).cast("bigint").alias("letters"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"),
        F.concat("c_name", F.when(some, "!")).alias("joined"),
        F.concat_ws("-", "c_mktsegment", F.when(some, "x")).alias("joined_ws"),
        F.format_string("no %d: %s", "c_custkey", "c_name").alias("line"),
    )


@query("fn_datetime", """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day, year(o_orderdate)::INT AS y,
       month(o_orderdate)::INT AS m, isodow(o_orderdate)::INT AS dow, week(o_orderdate)::INT AS iso_week,
       strftime(o_orderdate, '%d/%m-%Y') AS text,
       date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE))::INT AS diff,
       CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def fn_datetime(t):
    day = F.to_date("o_orderdate")
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        day.alias("day"),
        F.year(day).alias("y"),
        F.month(day).alias("m"),
        (F.weekday(day) + 1).alias("dow"),
        F.weekofyear(day).alias("iso_week"),
        F.date_format(day, "dd/MM-yyyy").alias("text"),
        F.datediff(day, F.lit(dt.date(1995, 6, 17))).alias("diff"),
        F.to_date(F.date_format(day, "d-M-yyyy"), "d-M-yyyy").alias("parsed"),
    )


@query("fn_weekday_name", """
SELECT o_orderkey AS order_id,
       ['mandag', 'tirsdag', 'onsdag', 'torsdag', 'fredag', 'lørdag', 'søndag'][isodow(o_orderdate)] AS weekday
FROM orders""")
def fn_weekday_name(t):
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        tx.weekday_name(F.to_date("o_orderdate")).alias("weekday"),
    )


@query("fn_number_format", """
SELECT o_orderkey AS order_id,
       translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS dotted,
       translate(format('{:,}', floor(o_totalprice)::BIGINT), ',', ' ') AS spaced,
       replace(format('{:.2f}', (o_orderkey % 10000) / 100.0), '.', ',') || ' %' AS percent FROM orders""")
def fn_number_format(t):
    price = F.col("o_totalprice")
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        tx.danish_number(price, 2).alias("dotted"),
        tx.danish_number(F.floor(price), 0, " ").alias("spaced"),
        tx.percent_text((F.col("o_orderkey") % 10000) / 10000).alias("percent"),
    )
