import unicodedata

import pytest
from pyspark.sql import functions as F

from snapledger.functions import labels, text
from snapledger.functions.numbers import per_90, price_in_millions, ratio, round_half_away


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "value, digits, expected",
    [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (1e300, 2, 1e300), (None, 1, None)],
)
def test_round_half_away(spark, value, digits, expected):
    assert one(spark, round_half_away(F.lit(value).cast("double"), digits)) == expected


def test_ratio_by_zero_is_null(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, ratio(F.lit(7), F.lit(2))) == 3.5
    assert one(spark, per_90(F.lit(4.0), F.lit(900))) == 0.4
    assert one(spark, per_90(F.lit(4.0), F.lit(0))) is None
    assert one(spark, price_in_millions(F.lit(62))) == 6.2


@pytest.mark.parametrize(
    "name, expected",
    [("Tünçağ", "tuncag"), ("Đurađ", "đurađ"), ("Østvang", "østvang"), ("Yalıoğan", "yalıogan"),
     ("Sérgio", "sergio"), (None, None)],
)
def test_name_key(spark, name, expected):
    assert one(spark, text.name_key(F.lit(name).cast("string"))) == expected


def test_strip_accents_matches_decomposition(spark):
    letters = [chr(c) for c in range(0xC0, 0x250)]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    got = {r.c: r.v for r in df.select("c", text.strip_accents(F.col("c")).alias("v")).collect()}

    def stripped(letter):
        kept = [c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c)[0] != "M"]
        return "".join(kept)

    assert got == {c: stripped(c) for c in letters}


def test_name_keys(spark):
    keys = text.name_keys(F.lit("Telmo Aires"), F.lit("Corvo Mendral"), F.lit("T.Mendral"))
    row = spark.range(1).select(*[c.alias(k) for k, c in keys.items()]).first()
    assert row.asDict() == {
        "full_name": "telmo aires corvo mendral", "short_name": "telmo mendral",
        "first_tokens": "telmo corvo", "web_name": "t.mendral",
    }


@pytest.mark.parametrize("date, year", [("2025-05-18", 2024), ("2025-07-01", 2025), ("2025-06-30", 2024), ("2025-08-16", 2025)])
def test_season_start_year(spark, date, year):
    assert one(spark, text.season_start_year(F.lit(date).cast("date"))) == year


def test_season_labels(spark):
    assert one(spark, text.season_label(F.lit(2025))) == "2025/26"
    page = F.lit("League stats for the 2025/2026 season | xG")
    assert one(spark, text.season_from_title(page)) == "2025"
    assert one(spark, text.season_from_title(page, override="2023")) == "2023"
    assert one(spark, text.season_from_deadline(F.lit("2026-08-15T17:30:00Z"))) == "2026"
    for broken in (text.season_from_title(F.lit("no season here")), text.season_from_deadline(F.lit(None))):
        with pytest.raises(Exception, match="season|deadline"):
            one(spark, broken)


def test_text_helpers(spark):
    assert one(spark, text.decode_apostrophe(F.lit("Lorne O&#039;Carrick"))) == "Lorne O'Carrick"
    assert one(spark, text.link("photos/p%d.png", F.lit(7))) == "photos/p7.png"
    assert one(spark, text.link("photos/p%d.png", F.lit(None).cast("int"))) is None
    assert one(spark, text.score_side(F.lit("2 : 0"), 2)) == 0
    assert one(spark, text.score_side(F.lit("postponed"), 1)) is None
    assert one(spark, text.contains_pattern("haa|ars", F.lit("Saka"), F.lit("ARSENAL"))) is True
    assert one(spark, text.contains_pattern("haa", F.lit("Saka"), F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(
    "status, chance, expected",
    [("a", None, "available"), ("a", 75, "likely"), ("i", 75, "likely"), ("i", 50, "doubtful"), ("i", 0, "high_risk"),
     ("s", None, "high_risk"), ("d", None, "unknown"), ("n", None, "unknown"), ("d", 25, "doubtful"), (None, 0, "high_risk")],
)
def test_availability(spark, status, chance, expected):
    risk = labels.availability_risk(F.lit(status).cast("string"), F.lit(chance).cast("int"))
    assert one(spark, risk) == expected


@pytest.mark.parametrize(
    "score, risk, expected",
    [(90.0, "high_risk", "drop"), (40.0, "doubtful", "monitor"), (39.9, "doubtful", "monitor"), (75.0, "likely", "transfer_in"),
     (74.9, "likely", "hold"), (40.0, None, "hold"), (39.9, "available", "monitor")],
)
def test_recommendation(spark, score, risk, expected):
    assert one(spark, labels.recommendation(F.lit(score), F.lit(risk).cast("string"))) == expected


@pytest.mark.parametrize(
    "now, before, expected",
    [(5, 4, "rising"), (4, 5, "falling"), (4, 4, "stable"), (4, None, "no_prior_snapshot"), (None, 4, "stable")],
)
def test_direction(spark, now, before, expected):
    trend = labels.direction(F.lit(now).cast("int"), F.lit(before).cast("int"), labels.PRICE_TRENDS)
    assert one(spark, trend) == expected


def test_small_labels(spark):
    assert [one(spark, labels.zone(F.lit(p))) for p in (4, 5, 6, 17, 18)] == ["top", "next", "middle", "middle", "bottom"]
    assert one(spark, labels.squad_slot(F.lit(12))) == "bench"
    assert one(spark, labels.squad_role(F.lit(False), F.lit(True))) == "vice"
    assert one(spark, labels.ordinal(F.lit("hold"))) == 2
    assert one(spark, labels.lookup(F.lit("other"), {"a": 1})) is None


def test_newest_row_of_a_key_without_order(spark):
    from snapledger.operators.snapshots import latest_per_key

    rows = spark.createDataFrame([("a", None, 1), ("b", 1, 1), ("b", None, 2), ("b", 3, 3)], "k string, at int, v int")
    assert sorted(map(tuple, latest_per_key(rows, ["k"], "at").collect())) == [("a", None, 1), ("b", 3, 3)]


def test_ids_beyond_four_bytes(spark):
    from snapledger.plans.silver import match_headers

    shape = "filename string, season string, load_date date, startDate string, ftScore string, attendance int, venueName string"
    raw = spark.createDataFrame([("x/3000000000.json", "2025", None, "2025-08-15T00:00:00", "2 : 0", 1, "v")], shape)
    side = "named_struct('teamId', parse_json('4000000000'), 'name', 't')"
    raw = raw.selectExpr("*", f"{side} as home", f"{side} as away")
    row = match_headers(raw).first()
    assert (row["match_id"], row["home_team_ws_id"]) == (3_000_000_000, 4_000_000_000)


def test_accents_beyond_the_basic_plane(spark):
    found = spark.createDataFrame([("\U0001109A",)], "t string").select(text.strip_accents(F.col("t"))).first()[0]
    assert found == "\U00011099"
