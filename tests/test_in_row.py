"""Steps that run in the rows of the texts give what their shuffled forms give, once and without a shuffle."""

import datetime as dt
import random

from postflow.catalog.composites import DIGESTS, LIMITS, PROMPT
from postflow.functions import pii, terms
from postflow.operators import matching, similarity
from postflow.plans import scoring
from postflow.sources import config


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_decisions_run_the_text_rules_once(spark):
    rows = spark.createDataFrame([("a", "scraped", "wort " * 60), ("b", "scraped", "zu kurz"), ("c", "scraped", "lang " * 2000),
                                  ("d", "open", "wort " * 60), ("e", "scraped", None)], "project_id string, state string, text string")
    cache = spark.createDataFrame([], "cache_key string, line long, project_id string, cache_hit boolean, best_score int")
    log = spark.createDataFrame([], "timestamp string, cost_usd decimal(18,6)")
    rules = (rows, cache, log, dt.date(2024, 1, 31), DIGESTS, PROMPT, "0" * 16, "m", "v1", LIMITS)
    facts = scoring.decisions(*rules)
    assert "regexp" not in plan(facts)[0].lower() and not set(facts.columns) & set(scoring.TEXTS)
    whole = scoring.requests_for(*rules)
    assert sorted_rows(whole.select(*facts.columns)) == sorted_rows(facts)
    assert {r.project_id: r.action for r in facts.collect()} == {"a": "send", "b": "unsafe_content", "c": "send", "e": "send"}
    assert {r.project_id: r.prompt is None for r in whole.collect()} == {"a": False, "b": False, "c": False, "e": True}


def test_scrub_guards_lose_no_match(spark):
    texts = {0: "ruf ٠١٢٣٤٥٦٧٨ an", 1: "Ms. Miller", 2: "Mrs.\tMoor", 3: "Hr. Ott und Fr. Alt", 4: "de89370400440532013000", 5: "a\x0b\x0bb [NAME]", 6: None}
    got = {r.i: r for r in pii.scrub(spark.createDataFrame(list(texts.items()), "i int, text string")).collect()}
    assert [got[i].n_name for i in (0, 1, 2, 3, 4)] == [0, 1, 1, 2, 0]
    assert got[0].n_phone == 1 and got[4].n_iban == 1 and got[6].scrubbed is None


def test_few_profiles_go_to_the_texts(spark):
    r = random.Random(5)
    words = [f"wort{k}" for k in range(40)] + ["und", "x", "für", "ärger"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(k, text(r.randint(0, 60))) for k in range(300)] + [(300, None), (301, ""), (302, "fremd fremd")], "id long, text string")
    profiles = spark.createDataFrame([(f"p{k}", k, text(r.randint(1, 20))) for k in range(250)] + [("leer", 250, "")],
                                     "profile_id string, profile_ord int, text string")
    near = similarity.similarities(docs, profiles, "id")
    assert "hashpartitioning(id" not in plan(near)[1]
    assert sorted_rows(similarity.similarities(docs, profiles, "id", top_n=3)) == sorted_rows(similarity.similarities(docs, profiles, "id", top_n=3, in_row=0))
    index = similarity.build_index(profiles)
    want = sorted_rows(similarity.best_profiles(docs, profiles, "id"))
    assert len(want) == 303 and sorted_rows(similarity.search_profiles(docs, index, "id")) == want
    assert sorted_rows(similarity.search_profiles(docs, index, "id", in_row=0)) == want
    empty = profiles.where("1 = 0")
    assert [tuple(x) for x in similarity.best_profiles(docs.where("id = 1"), empty, "id").collect()] == [(1, None, 0.0, [])]


def test_few_rules_go_to_the_texts(spark):
    entries = ["anat", "thha*", "le la", "é", "+1", "a", {"term": "der", "with": ["wh*", "para"]}]
    rows = [("g", "include", t.term, [c.term for c in t.context], t.pattern, t.needle, i) for i, t in enumerate(terms.compile_terms(entries))]
    rules = spark.createDataFrame(rows, config.TERM_RULE)
    r = random.Random(2)
    parts = ["anat", "Thhaha", "le-la", "é", "+1", "a", "der", "what", "para", "xanat", "\n", "ab"]
    docs = spark.createDataFrame([(k, " ".join(r.choice(parts) for _ in range(r.randint(0, 6))), "", None) for k in range(200)],
                                 "doc_id long, description string, title string, schlagworte string")
    few = matching.match_rule_table(docs, rules, "doc_id")
    assert "Exchange hashpartitioning" not in plan(few)[1]
    assert sorted_rows(few) == sorted_rows(matching.match_rule_table(docs, rules, "doc_id", in_row=0)) and few.count() > 200
    assert matching.match_rule_table(docs, rules.where("1 = 0"), "doc_id").count() == 0
