"""Scalar rules on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from postflow.functions import (dates, mail, markdown as M, pii, postings as P, responses as R,
                                terms as T, text as X, urls)


def one(spark, value, *columns):
    """Evaluate columns over one string ``v``."""
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


V = F.col("v")


def test_identity_and_ids(spark):
    url = "https://www.freelancermap.de/projekt/99999"
    assert one(spark, url, urls.project_id(V, F.lit("x"))) == "url-a06de2aecc89"
    assert one(spark, " HTTPS://WWW.Freelancermap.de/projekt/99999/?a=1#x ", urls.project_id(V, F.lit(""))) == "url-a06de2aecc89"
    assert one(spark, "http://Host.de/a;p=1/b;q=2/", urls.identity_url(V)) == "http://host.de/a;p=1/b;q=2"
    assert one(spark, "Großes Projekt!", urls.title_slug(V)) == "gro-es-projekt"
    assert one(spark, "", urls.project_id(V, F.lit("T"))).startswith("ttl-")
    assert one(spark, None, urls.project_id(V, V, F.lit("row"))).startswith("unk-")


def test_tracking_free_url(spark):
    url = "https://A.de/p/?utm_source=x&b=2%20c&a=&ref=y&b=3&q=a+b#frag"
    assert one(spark, url, urls.tracking_free_url(V)) == "https://a.de/p?b=2 c&q=a b"


def test_feed_label(spark):
    assert one(spark, "https://x.de/feeds/de.xml", urls.feed_label(F.lit("freelancermap"), V)) == "DE"
    assert one(spark, "https://x.de/feeds/it.rss", urls.feed_label(F.lit("gulp"), V)) == "gulp:IT"


def test_fingerprint_changes_with_rules():
    a = urls.rules_fingerprint({"include_terms": ["A"]}, [])
    assert a == urls.rules_fingerprint({"include_terms": ["A"]}, []) and len(a) == 12
    assert a != urls.rules_fingerprint({"include_terms": ["A"]}, ["B"])


def found(spark, entries, text):
    return one(spark, text, T.matched(T.compile_terms(entries), T.search_form(V)))


def test_term_rules(spark):
    for text in ("Power BI", "PowerBI-Berater", "power-bi", "POWER  BI!"):
        assert found(spark, ["Power BI"], text) == ["Power BI"]
    assert found(spark, ["API-Integration"], "Kapital-Integration, KAPI Integration") == []
    assert found(spark, ["Firewall*"], "viele FIREWALLS") == ["Firewall*"]
    assert found(spark, ["Firewall"], "viele Firewalls") == []
    assert found(spark, ["Make.com"], "Makexcom") == [] and found(spark, ["Make.com"], "mit make.com!") == ["Make.com"]
    assert found(spark, ["Übersetzer*"], "ÜBERSETZERIN gesucht") == ["Übersetzer*"]
    dax = [{"term": "DAX", "with": ["Power BI", "Measure*"]}]
    assert found(spark, dax, "DAX-Konzern") == [] and found(spark, dax, "DAX Measures") == ["DAX"]


def test_column_compiler_equals_driver_compiler(spark):
    for term in ("Power BI", "Firewall*", "Make.com", "LAN/WAN", " ISO-27001 ", "Prüf*"):
        assert one(spark, term, T.term_pattern(V)) == T.compile_term(term).pattern
    assert T.compile_term(" * ") is None and one(spark, " * ", T.term_pattern(V)) is None


def test_written_pattern_starts_with_the_word_start(spark):
    """the pattern that p15_term_pattern returns; it hits what the searched form hits."""
    start, end = f"(?<![{T.WORD}])", f"(?![{T.WORD}])"
    for term, body in (("Power BI", f"power{T.GAP}bi" + end), ("Firewall*", "firewall"), (" c++ -x ", rf"c\+\+{T.GAP}x" + end)):
        written = one(spark, term, T.term_pattern(V, first="start"))
        assert written == start + body
        for text in ("power-bi", "xpower bi", "firewalls", "c++x", "ac++ x", "c++ x1", "power bix"):
            assert one(spark, text, V.rlike(written)) == one(spark, text, V.rlike(T.compile_term(term).pattern))
    assert one(spark, " * ", T.term_pattern(V, first="start")) is None


def test_tokens(spark):
    text = "Für die M365-Lösung (CI/CD), k8s & 'Über' ISO-27001; x das API."
    assert one(spark, text, X.tokens(V)) == ["fuer", "m365", "loesung", "ci", "cd", "k8s", "ueber", "iso", "27001", "api"]
    assert one(spark, " - . ", X.tokens(V)) == []


def test_truncation(spark):
    short, cut = X.truncate_middle(V, 400)
    text, was = one(spark, "a" * 300 + "b" * 300, short, cut)
    assert was and text.startswith("a" * 150 + "\n\n[") and text.endswith("]\n\n" + "b" * 150)
    assert one(spark, "x" * 500, X.truncate_middle(V, 200)[0]) == "x" * 200
    assert one(spark, "abc", X.estimate_tokens(V)) == 1


def test_rates(spark):
    def rates(text):
        return one(spark, text, P.hourly_rate(V), P.daily_rate(V))
    assert rates("Stundensatz: 95,50 EUR") == (95.5, None)
    assert rates("90 €/Std.") == (90.0, None)
    assert rates("Tagessatz ca. 1.200") == (None, 1200.0)
    assert rates("1200.50 € / Tag") == (None, 120050.0)  # dots are thousands separators
    assert rates("kein Satz") == (None, None)


def test_work_mode_and_contract(spark):
    assert one(spark, "Einsatz vor Ort, teils Remote", P.work_mode(V)) == "remote"
    assert one(spark, "Präsenz", P.work_mode(V)) == "onsite"
    assert one(spark, "nichts", P.work_mode(V)) is None
    assert one(spark, " ANÜ ", P.contract_type(V)) == "anue"
    assert one(spark, "keine ANÜ", P.contract_type(V)) is None
    assert one(spark, "keine ANÜ, Festanstellung möglich", P.contract_type(V)) is None  # still in the window
    assert one(spark, "Das ist ein Projekt", P.contract_type(V)) == "freelance"
    assert one(spark, "Sprache: Deutsch und English", P.languages(V)) == ["de", "en"]


def test_conditions(spark):
    def load(text):
        return tuple(one(spark, text, P.workload(V)))
    assert load("20-30 Std. / Woche")[:2] == ("erfüllt", "20–30 h/Woche")
    assert load("3 Tage pro Woche")[:2] == ("erfüllt", "3 Tage pro Woche (24 h/Woche)")
    assert load("Auslastung: 50 %")[:2] == ("erfüllt", "50 % (20 h/Woche)")
    assert load("45 Stunden pro Woche")[0] == "nicht erfüllt"
    assert load("Vollzeit")[:2] == ("erfüllt", "Vollzeit (40 h/Woche)")
    assert load("Teilzeit") == ("unbekannt", "Teilzeit", "Teilzeit ohne Stundenangabe")


def test_start_dates(spark):
    today = dt.date(2026, 10, 10)

    def start(text):
        row = one(spark, text, P.start_date(V, today))
        return tuple(row) if row else None
    assert start("Start: asap") == (today, "sofort")
    assert start("Zeitraum: 19.10.2026 – 30.06.2027") == (dt.date(2026, 10, 19), "19.10.2026")
    assert start("Beginn: Mitte März") == (dt.date(2027, 3, 15), "15.03.2027")
    assert start("Start: asap - spätestens zu November 2026") == (dt.date(2026, 11, 1), "sofort bis spätestens 01.11.2026")
    assert start("Starttermin: 01.11.2026 oder 15.11.2026") == (dt.date(2026, 11, 15), "spätestens 15.11.2026")
    assert start("Start: 32.01.2026") is None and start("ohne Angabe") is None


def test_must_sections_overlap(spark):
    text = "Anforderungen:\n- A\nMUSS-Kriterien:\n- B\nSOLL-Kriterien:\n- C\nAnforderungsworkshops sind keine Überschrift"
    sections = one(spark, text, P.must_sections(V))
    assert sections.count("- B") == 2 and "- C" not in sections
    long = "Profil:\n" + "x" * 3000
    assert len(one(spark, long, P.must_sections(V))) == 2500


def test_pii(spark):
    text = ("Wir suchen Hilfe. " * 12 + "Frau Meier, max@firma.de, +49 30 1234567\nTel: 030 99999\n"
            "IBAN DE89 3704 0044 0532 0130 00 Ende\nMit freundlichen Grüßen\nKarl")
    df = pii.scrub(spark.createDataFrame([(text,)], "text string"))
    row = df.first()
    assert "[NAME]" in row.scrubbed and "[EMAIL]" in row.scrubbed and "[IBAN]" in row.scrubbed
    assert "[SCRUBBED]" in row.scrubbed and "Karl" not in row.scrubbed and row.n_signature == 1 and row.safe
    assert df.select(pii.replacements()).first()[0]["email"] == 1
    assert not pii.scrub(spark.createDataFrame([("kurz",)], "text string")).first().safe
    thread = "Inhalt\nVon: a\nGesendet: b\nalt"
    assert pii.scrub(spark.createDataFrame([(thread,)], "text string")).first().scrubbed == "Inhalt"


def test_scores_in_bodies(spark):
    def section(day, pre, fit):
        return f"{M.EVALUATION_MARK}\n\n**Evaluation Timestamp:** {day}\n- **Score:** {pre}/100\n- **Fit Score:** {fit}/100\n"
    body = section("2026-01-02T00:00:00", 10, 20) + section("2026-03-01T00:00:00.123", 30, 40) + section("bad", 1, 2)
    assert tuple(one(spark, body, M.latest_scores(V))) == (30, 40)
    assert tuple(one(spark, "- **Score:** 7/100", M.latest_scores(V))) == (7, None)
    assert one(spark, "**LLM Score:** 55%", M.percent_score(V)) == 55 and one(spark, "x", M.percent_score(V)) == 0
    assert one(spark, "- **Score-Art:** Eignung (x)", M.score_kind(V, F.lit(3))) == "eignung"


def test_file_timestamps(spark):
    stamp = dates.file_timestamp(V)
    assert one(spark, "p_20260102_030405.md", stamp) == dt.datetime(2026, 1, 2, 3, 4, 5)
    assert one(spark, "p_20261332_2026-02-03.md", stamp) == dt.datetime(2026, 2, 3)
    assert one(spark, "none.md", stamp) is None


def test_message_urls(spark):
    df = spark.createDataFrame([("Siehe https://x.de/projekt/1 und https://x.de/projekt/1",
                                 '<a class="k" href="https://x.de/projekt/2">a</a><a href="https://x.de/abmelden/projekt/">b</a>')], "t string, h string")
    got = df.select(mail.message_urls(F.col("t"), F.col("h"), [r"https://x\.de/\S*projekt/\d*"], ["abmelden"])).first()[0]
    assert sorted(got) == ["https://x.de/projekt/1", "https://x.de/projekt/2"]
    match = mail.mail_match(F.lit("Bot <a@x.de>"), F.lit("Neues PROJEKT"), ["@x.de"], ["projekt"])
    assert df.select(match).first()[0]


def test_response_validation(spark):
    def item(pid, score="50"):
        return f'{{"profile_id": "{pid}", "score": {score}, "matched": {[str(i) for i in range(9)]}, "missing": [], "rationale": "r"}}'.replace("'", '"')

    def check(raw):
        return one(spark, raw, R.validate_response(V, ["a", "b"]))
    ok = check("```json\n{\"evaluations\": [" + item("a") + "," + item("b", "7.9") + "]}\n```")
    assert ok.error is None and [e.score for e in ok.evaluations] == [50, 7] and len(ok.evaluations[0].matched) == 7
    assert "expected 2" in check('{"evaluations": [' + item("a") + "]}").error
    assert "duplicate" in check('{"evaluations": [' + item("a") + "," + item("a") + "]}").error
    assert "unknown" in check('{"evaluations": [' + item("a") + "," + item("z") + "]}").error
    assert "outside" in check('{"evaluations": [' + item("a") + "," + item("b", "101") + "]}").error
    assert "no number" in check('{"evaluations": [' + item("a") + "," + item("b", '"x"') + "]}").error
    assert check("nothing").evaluations is None
    assert one(spark, "64", R.priority_label(V.cast("int"))) == "review"


def test_shown_float_is_python_text(spark):
    values = [95.5, 1e7, 12345678.95, 4297648922181334.0, 9999999999999998.0, 1e16, 4.297648922181334e+22, 0.5, 0.001, 0.00025, 1.5e-05, 2e-10, 0.0, -12345678.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.shown_float(F.col("v"))).collect()] == [repr(v) for v in values]
    assert matching_reason(spark, 4297648922181334.0) == "Tagessatz 4297648922181334.0€ > Maximum 1300.0€"


def matching_reason(spark, daily):
    from postflow.operators import matching
    from postflow.sources.config import RateBounds
    df = spark.createDataFrame([("t", "d", daily)], "title string, description string, daily_rate double")
    return df.select(matching.check_rate(df, RateBounds(80.0, 130.0, 600.0, 1300.0), F.col("title"))["reason"]).first()[0]


def test_terms_are_searched_by_their_letters(spark):
    """the letters of a term come first in its pattern; the look back at the word start changes no result."""
    assert [T.compile_term(t).pattern.startswith(p) for t, p in (("an-at*", "an(?<!"), ("c++", r"c\+\+(?<!"))] == [True, True]
    texts = ["anat", "xanat anat", "xanat", "anatx", "ßanat", "anat.", "İanat", "an at", "", "ſanat _anat"]
    old = rf"(?<![{T.WORD}])anat(?![{T.WORD}])"
    term, rows = T.compile_terms(["anat"]), spark.createDataFrame([(t,) for t in texts], "v string")
    got = rows.select(T.search_form(V).alias("low")).select(F.size(T.matched(term, F.col("low"))) > 0, F.col("low").rlike(old)).collect()
    assert all(a == b for a, b in got) and sum(a for a, _ in got) == 4


def test_hours_and_headings_are_read_from_what_can_hold_them(spark):
    """one search finds the places of all forms of weekly hours; a heading may start the text."""
    import re as python_re
    texts = ["1 - 20-30 Std./Woche", "12 bis 34 Tage pro Woche", "8h je Woche, 3 bis 4 Tage die Woche", "123 Stunden pro Woche", "5 Tage", "Woche 5"]
    assert [[m[0] for m in python_re.finditer("(?i)" + P.WEEKLY, t)] for t in texts] == [
        ["20-30 Std./Woche"], ["12 bis 34 Tage pro Woche"], ["8h je Woche", "3 bis 4 Tage die Woche"], ["23 Stunden pro Woche"], [], []]
    got = [one(spark, t, P.weekly_hours(V)) for t in texts]
    assert [g and (g.lo, g.hi, g.label) for g in got] == [(20, 30, None), (32, 32, "4 Tage pro Woche"), (8, 8, None), (23, 23, None), None, None]
    for text, want in (("Profil:x", "x"), ("**Profil**y", "y"), ("\nPROFIL:z", "z"), ("*Profil:x", ""), ("kein", ""), (None, None)):
        assert one(spark, text, P.must_sections(V, T.search_form(V))) == one(spark, text, P.must_sections(V)) == want


def test_rates_of_both_units_from_one_search(spark):
    """the amounts of both units are found together, as each is found alone."""
    for text in ("95,50 EUR/Std und 1.200 EUR / Tag", "5 hours 7 hour 9 h", "Rate 3, 8 pt 9 ptx", "٣ h 4 h", "Stundensatz: 80 3 Tage", "1.2.3 h 4.5.6 day", "", None):
        assert tuple(one(spark, text, P.rates(V))) == tuple(one(spark, text, F.struct(P.hourly_rate(V), P.daily_rate(V)))), text
    low = "sprache: deutsch, en, auf englisch vlaamse _nl"
    assert one(spark, low, P.languages(V)) == ["de", "en", "nl"]


def test_terms_of_a_text_come_from_one_search(spark):
    """the words that begin with a term's head decide its terms as searches of the whole text do."""
    entries = ["anat", "thha*", "an-at*", "et", "le la", "c++", {"term": "onre", "with": ["ing the", "that of"]}]
    terms = T.compile_terms(entries)
    texts = ["anat", "xanat", "anatx éanat", "an at ethe", "an-\n-atx", "(et,thhab)", "lela", "le  la", "xle la", "c++ et_", "onre THAT\tof", "onre ingthe",
             "onre xing the", "😀ſthha İanat", "anat anat", "", "ßet et", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(T.search_form(V).alias("low"))
    got = rows.select(T.matched(terms, F.col("low"), T.term_words(terms, F.col("low"), ["must"])), T.matched(terms, F.col("low"))).collect()
    assert all(a == b for a, b in got) and sum(len(a) for a, _ in got) == 17
    assert one(spark, "xmust musts,an (etc) anatol", T.term_words(terms, V, ["must"])) == " musts an etc anatol "
    assert one(spark, "et", T.term_words([], V)) == ""


def test_narrowed_texts_keep_their_hits(spark):
    """headings are read from the line of the first heading word, weekly hours from shortly before the first week."""
    for text, want in (("é\n\t ihr Profil: x\nnice-to-have y", " x\n"), ("profilx\n**  dein Profil**y", "y"), ("a*\n* Profil:z", ""), ("z\n*MUSS-Kriterien:a\nProfil:b", "b"),
                       ("Anforderungen:" + "😀" * 2600, "😀" * 2500), ("kein", ""), ("", ""), (None, None)):
        low, full = T.search_form(V), P.must_sections(V)
        words = T.term_words([], low, P.MUST_WORDS)
        assert one(spark, text, P.must_sections(low, folded=True, words=words)) == one(spark, text, P.must_sections(low, folded=True)) == want, text
        assert one(spark, text, T.search_form(full)) == want, text
    for lead in ("", "é" * 300, "1 " * 80, "Woche " * 30):
        assert one(spark, lead + "12" + " " * 150 + "Std." + "\n" * 90 + "pro Woche", P.weekly_hours(V)).lo == 12, lead
        assert one(spark, lead + " 2 bis 3 Tage je WOCHE", P.weekly_hours(V)).label == "2 bis 3 Tage je WOCHE", lead
    day = dt.date(2024, 1, 31)
    assert one(spark, "😀éprojektstart: 02.05.2024", P.start_date(V, day)).start == dt.date(2024, 5, 2)
    assert one(spark, "éééstart: 03.05.2024, beginn: zeit", P.start_date(V, day)).shown == "03.05.2024"
