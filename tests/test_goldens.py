"""Known cases, re-typed as small tables, for branches the given tables cannot reach."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from civicmill.functions import classify as K
from civicmill.functions import ids as I
from civicmill.functions import text as T
from civicmill.functions import times as C
from civicmill.operators import calendar as O
from civicmill.operators import diffs as G
from civicmill.operators import labels as L
from civicmill.operators import similarity as Sim
from civicmill.operators import votes as V
from civicmill.sources import readers as Rd


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_refid_class(spark):
    rows = [("H14V2610034", 0, False, "VOTE_COMMITTEE"), ("26110000", 0, True, "VOTE_FLOOR"), ("5354", 63, False, "BATCH_NOTICE"), ("5141", 1, False, "SINGLETON_DOC"), ("5141", 2, False, "BATCH_NOTICE"),
            ("5354", 63, True, "VOTE_FLOOR"), ("WEIRD-XYZ", 0, False, "UNKNOWN_REFID"), ("", 0, False, "EMPTY"), ("<NA>", 0, False, "EMPTY"), (None, 0, False, "EMPTY"), ("26110000", 0, False, "VOTE_UNMATCHED"),
            ("H14", 0, False, "COMMITTEE_REF"), ("26108316D", 0, False, "DOCUMENT"), ("HB1000F122", 0, False, "DOCUMENT"), ("HB1000F122F999", 0, False, "UNKNOWN_REFID"), ("26110000.0", 0, True, "VOTE_FLOOR")]
    got = values(spark, rows, "r string, f int, v boolean, want string", K.refid_class("r", "f", "v"), "want")
    assert all(a == b for a, b in got), got


def test_route(spark):
    rows = [("21-Y 19-N", "G7320", "", "", "", False, "meeting"), ("", "G7900", "", "", "", True, "executive"), ("", "S5620", "", "", "", True, "admin"), ("", "H1", "Committee", "", "", False, "admin"),
            ("", "G7050", "", "", "", False, "admin"), ("", "H4130", "", "", "In House", False, "meeting"), ("", "H4130", "", "", "", False, "meeting"), ("", "H9", "", "", "Brand New", False, "admin")]
    df = spark.createDataFrame(rows, "vote_tally string, event_code string, reference_type string, actor string, status string, m boolean, want string").withColumn("event_date", F.lit("2026-02-12T00:00:00"))
    assert all(r[0] == r[1] for r in df.select(K.route_event("m")["route"], "want").collect())


def test_heal(spark):
    rows = [(None, "", False), ("None", "", True), ("null", "", True), ("nan", "", True), (" None ", "", True), ("Noney", "Noney", False), ("0", "0", False)]
    assert all((a, b) == (w, h) for a, b, w, h in values(spark, rows, "c string, w string, h boolean", I.heal_cell("c"), I.was_healed("c"), "w", "h"))


def test_delta_guard(spark):
    rows = [(None, 5000, None, None, False), (12, 20, None, None, False), (100, 125, None, None, True), (60, 120, None, None, True), (2, 4, None, None, False), (2, 12, None, None, True), (12, 3012, 3645, 6645, False),
            (12, 512, 3645, 3645, True), (12, 412, 3645, 3745, True)]
    got = values(spark, rows, "p int, c int, pu int, cu int, want boolean", O.delta_alarm("p", "c", "pu", "cu"), "want")
    assert all(a == b for a, b in got), got


def test_history_diff(spark):
    schema = "bill string, date string, refid string, action string, seq int"
    prev = spark.createDataFrame([("HB1", "d", "R1", "12-Y 9-N", 1), ("HB1", "d", "", "Filed", 2)], schema)
    now = spark.createDataFrame([("HB1", "d", "R1", "12-Y 10-N", 1), ("HB1", "d", "", "Filed again", 2)], schema)
    assert sorted(r["kind"] for r in G.diff_history(prev, now).collect()) == ["history_added", "history_edited", "history_removed"]


def test_companion_groups_count_every_pair(spark):
    bills = spark.createDataFrame([("HB1", "Tax", "s"), ("HB2", "tax ", "s"), ("SB3", "Tax", "s"), ("SB4", "Tax", "other"), ("HB5", "Alone", "s")], "bill string, title string, session string")
    assert [r["pairs"] for r in Sim.companion_groups(bills).collect()] == [2]
    tracked = spark.createDataFrame([("SB3",)], "bill string")
    assert [tuple(r) for r in Sim.counterparts_of(bills, tracked).collect()] == [("SB3", "tax", 2, "HB1", "HB2")]


def test_compatibility_forms_compare_equal(spark):
    """Ligature, circled digit and full-width letters read as what they stand for; ASCII text is left alone."""
    rows = [("the \ufb01nal o\ufb03ce \u2460 \uff21ct", "the final office 1 act"), ("plain text", "plain text"), (None, "")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, want string").select(T.normalize_text("t") == F.col("want")).collect()]
    assert got == [True, True, True]


def test_pair_verdicts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([("HB1", words), ("SB1", words), ("HB2", words), ("SB2", "nothing at all alike here"), ("HB3", words), ("SB4", words + " " + " ".join(f"z{i}" for i in range(400))), ("HB4", words)], "bill string, text string")
    pairs = spark.createDataFrame([("HB1", "SB1"), ("HB2", "SB2"), ("HB3", "SB3"), ("HB4", "SB4")], "house string, senate string")
    got = {r["house"]: r["verdict"] for r in Sim.compare_pairs(pairs, texts).collect()}
    assert got == {"HB1": "confirmed", "HB2": "weak", "HB3": "unverifiable", "HB4": "confirmed"}


def test_roll_call_lines(spark):
    lines = spark.createDataFrame([("26110000,H0056,N,H0108,Y",), ("VSV1001",), ("H14V1,H1,P,H2",), ("",)], "value string")
    got = {(r["member"], r["token"]) for r in V.parse_roll_calls(lines).collect()}
    assert got == {("H0056", "N"), ("H0108", "Y"), ("H1", "P")}
    h = V.parse_health(lines).first()
    assert (h["rows"], h["rows_with_members"], h["no_detail_voice_or_standing"], h["unknown_tokens"], h["unpaired_cells"]) == (3, 2, 1, 1, 1)


def test_strict_majority_and_breaks(spark):
    seats = [("c", 1, "a", "D", "Chair"), ("c", 1, "b", "D", "M"), ("c", 1, "d", "R", "M"), ("c", 2, "a", "D", "M"), ("c", 2, "d", "R", "M"), ("c", 3, "a", "D", "M"), ("c", 3, "d", "R", "M"), ("u", 1, "a", "D", "M"), ("u", 1, "b", "", "M")]
    comp = V.composition(spark.createDataFrame(seats, "committee string, session int, member string, party string, role string"), ["committee", "session"])
    got = {(r["committee"], r["session"]): r["majority_party"] for r in comp.collect()}
    assert got == {("c", 1): "D", ("c", 2): None, ("c", 3): None, ("u", 1): None}
    breaks = V.composition_breaks(comp, "committee", "session").collect()
    assert [(r["from_session"], r["to_session"], r["chair_changed"]) for r in breaks] == [(1, 2, True)]


def test_clean_days(spark):
    day = lambda d: dt.datetime(2026, 7, d)
    rows = [(day(1), None, "_genesis")]
    state = lambda rows: O.clean_days(spark.createDataFrame(rows, "start timestamp, end timestamp, cls string"), "2026-07-20 00:00:00").first()["days_clean"]
    assert state(rows) == 19
    assert state(rows + [(day(8), day(10), "accuracy")]) == 10
    assert state(rows + [(day(15), None, "degraded")]) == 5
    assert state(rows + [(day(19), day(19), "_drill")]) == 19


def test_relative_chain(spark):
    rows = [("d", "senate adjourned", 13 * 60 + 26, None, 0), ("d", "general laws", None, "senate adjourned", 30), ("d", "sub of general laws", None, "general laws", 0), ("d", "lost", None, "nobody", 10),
            ("d", "a", None, "b", 1), ("d", "b", None, "a", 1)]
    got = {r["name"]: r["minutes"] for r in O.relative_chain(spark.createDataFrame(rows, "date string, name string, minutes int, anchor string, offset int")).collect()}
    assert got == {"senate adjourned": 806, "general laws": 836, "sub of general laws": 837, "lost": None, "a": None, "b": None}


def test_quiet_minutes(spark):
    t = lambda d, h: dt.datetime(2026, 7, d, h) + dt.timedelta(hours=5)  # fixed -5 h local clock
    rows = [(t(15, 10), t(15, 14), 0.0), (t(15, 0), t(15, 5), 300.0), (t(15, 20), t(16, 6), 420.0), (t(15, 8), t(15, 16), 0.0), (t(15, 14), t(15, 10), 0.0)]
    assert all(a == b for a, b in values(spark, rows, "a timestamp, b timestamp, w double", C.quiet_minutes("a", "b"), "w"))


def test_forward_horizon(spark):
    d = dt.date
    rows = [(d(2026, 1, 20), d(2026, 6, 1), d(2026, 2, 1), True, d(2026, 2, 15)), (d(2026, 5, 15), d(2026, 5, 15), d(2026, 5, 10), True, d(2026, 5, 15)), (d(2026, 5, 15), d(2026, 5, 15), d(2026, 6, 30), True, d(2026, 8, 14)),
            (d(2026, 5, 15), d(2026, 5, 15), d(2026, 9, 1), True, d(2026, 10, 16)), (d(2025, 3, 1), d(2025, 3, 1), d(2026, 6, 30), False, d(2025, 3, 1)), (d(2026, 7, 14), d(2026, 7, 14), d(2026, 6, 30), True, d(2026, 7, 14))]
    got = values(spark, rows, "s date, e date, t date, live boolean, w date", C.forward_horizon("s", "e", "t", "live"), "w")
    assert all(a == b for a, b in got), got


def test_labelled_links(spark):
    a, v = "https://files/1.PDF", "https://video/3"
    rows = [(1, f'x <a href="{a}">(Agenda)</a> <a href="{v}">(View Meeting)</a>', a, v), (2, f'<a href="{v}">(View Meeting)</a>', "", v), (3, f'<a href="{a}">(Agenda and View Meeting)</a>', a, a), (4, '<a href="u">Subommittee Info</a>', "", ""),
            (5, '<a href="u">(Hologram Briefing)</a>', "", ""), (6, "none", "", "")]
    links, drift = Rd.labelled_links(spark.createDataFrame(rows, "k int, html string, wa string, wm string").select("k", "html"), "html", "k")
    assert {r["k"]: (r["agenda"], r["meeting"]) for r in links.collect()} == {r[0]: (r[2], r[3]) for r in rows}
    assert [r["label"] for r in drift.collect()] == ["hologram briefing"]


def test_names_and_tokens(spark):
    rows = [("Adams, D.M.", "d m adams"), ("Thomas K. Norment, Jr.", "thomas k norment"), ("Kelly Convirs-Fowler", "kelly convirs-fowler"), (None, "")]
    assert all(a == b for a, b in values(spark, rows, "n string, w string", F.array_join(I.name_tokens("n"), " "), "w"))
    text = spark.createDataFrame([("Stricken from the docket",)], "t string").select(T.procedure_tokens("t", True)).first()[0]
    assert text == ["stricken", "docket", "stricken_from", "from_the", "the_docket"]


def test_session_codes_and_dates(spark):
    assert values(spark, [("261", "20261", 2026), ("20252", "20252", 2025), ("26", "26", None)], "c string, a string, y int", I.normalize_session_code("c"), I.session_year(I.normalize_session_code("c"))) == [("20261", 2026), ("20252", 2025), ("26", None)]
    rows = [("02/12/2026", dt.date(2026, 2, 12)), ("2026-02-12", dt.date(2026, 2, 12)), ("02/12/26", dt.date(2026, 2, 12)), ("02/31/2026", None), ("soon", None), (None, None)]
    assert all(a == b for a, b in values(spark, rows, "s string, w date", C.parse_date("s"), "w"))


def test_entropy_boundaries(spark):
    docs = spark.createDataFrame([(i, "alpha common", "A") for i in range(4)] + [(9, "beta common", "B")], "doc int, text string, label string")
    got = {r["tok"]: (r["support"], r["entropy"], r["top_label"]) for r in L.token_stats(L.doc_tokens(docs)).collect()}
    assert got["alpha"] == (4, 0.0, "A") and got["beta"] == (1, 0.0, "B") and got["common"][0] == 5 and abs(got["common"][1] - 0.721928095) < 1e-9


def test_lexical_match_prefers_length_then_place(spark):
    titles = spark.createDataFrame([("death penalty appeals",), ("appeals after naloxone",), ("naloxone kits",)], "nt string")
    tax = spark.createDataFrame([("death penalty", "DP"), ("appeals", "AP"), ("naloxone", "NX")], "name string, label string")
    got = {r["nt"]: (r["label"], r["conf"]) for r in L.lexical_match(titles, tax, 3).collect()}
    assert got == {"death penalty appeals": ("DP", 0.89), "appeals after naloxone": ("AP", 0.81), "naloxone kits": ("NX", 0.81)}


def test_normal_form_of_a_batch_is_made_part_by_part():
    got = T.nfkc.func(pa.array(["ﬁn", None, "É", ""] * 130))
    assert got.to_pylist() == ["fin", None, "É", ""] * 130
    assert T.nfkc.func(pa.array([], pa.string())).to_pylist() == []
