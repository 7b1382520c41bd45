"""Links, places, titles and the interpretation of documents against plain loops."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.operators import documents, extraction, gazetteer, links

# --- DOIs


def read_by_words(text, start):
    """An identifier put together from the words that begin at `start`: a word is joined to what ends in /, - or _, or in a full stop if the word has a digit, a stop or a slash."""
    (_, out), *rest = re.findall(r"(\s*)([\w\-.;()/:+]*)", text[start:])
    for space, word in rest:
        if not (space and word and out and (out[-1] in "/-_" or (out[-1] == "." and re.search(r"[./\d]", word)))):
            break
        out += word
    return out


PIECES = ["10.1016/", "10.5194/", "j.quat", ".", "-", "/", "_", " ", "\n", "  ", "2019", "abc", "12", ";", "(", ")", ",", " 10.1000/x", "é", "doi. org/", "–", "doi ", "\n# References\n", " this article "]


@pytest.mark.parametrize("seed", range(5))
def test_dois_are_read_word_by_word(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = links.repaired("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))))
        for m in links.DOI_PREFIX.finditer(text):
            assert links.READ.match(text, m.start())[0].translate({9: None, 10: None, 13: None, 32: None}) == read_by_words(text, m.start())


def test_links_of_documents(spark):
    filler = "word " * 1200
    parts = [
        ("a", 0, "title", "Report doi: 10.1000/title-1"), ("a", 1, "text", filler + "10.1000/other-2 " * 3),
        ("b", 0, "pdf_metadata", "PII: S0277-3791(01)00123-x\nSubject"), ("b", 1, "text", None),
        ("c", 0, "text", "Cite this article: 10.1000/\nown-\n77. Next " + "x " * 200 + "\n# References\nDOI 10.1000/ref-1 and 10.1000/ref-1"), ("d", 0, "text", "nothing 10.1000/x, 10.1000/j"), ("e", 0, "artifact", "10.1000/tie-a"), ("e", 1, "artifact", "10.1000/tie-b"),
    ]
    df = spark.createDataFrame(parts, "source_id string, seq int, source string, text string")
    got = {r["source_id"]: (r["doi"], r["source"], r["score"], r["finds"]) for r in links.source_links(df).collect()}
    assert got == {"a": ("10.1000/title-1", "title", 195, 1), "b": ("10.1016/S0277-3791(01)00123-X", "pdf_metadata_pii", 110, 1), "c": ("10.1000/own-77", "text", 145, 1), "e": ("10.1000/tie-a", "artifact", 115, 1)}
    records = spark.createDataFrame([("a", "1", " "), ("a", "2", "http://kept"), ("d", "3", None), (None, "4", "")], "source_id string, id string, doi_or_url string")
    filled = {r["id"]: r["doi_or_url"] for r in links.with_source_links(records, links.source_links(df)).collect()}
    assert filled == {"1": "https://doi.org/10.1000/title-1", "2": "http://kept", "3": None, "4": ""}


# --- places


def plain_variants(queries, title, text, most):
    strip = lambda s: " ".join(s.split()).strip(" ,.;:")
    out = []
    for q in queries or []:
        c = strip((q or "").replace("–", "-"))
        low = c.lower()
        if not c or low in gazetteer.NO_PLACES or any(re.fullmatch(p, low) for p in gazetteer.NO_PLACE_PATTERNS) or ("submerged palaeolandscape" in low and "malta" not in low):
            continue
        for phrase, values in gazetteer.KNOWN_PLACES:
            out += values if phrase in low else ()
        out += [c, *(re.sub(rf"\b{w}\b", "", c, flags=re.I).strip(" ,.;:") for w in ("continental shelf", "shelf", "offshore"))]
        e = f" {c} "
        for a, b in gazetteer.ABBREVIATIONS:
            e = e.replace(a, b)
        out.append(" ".join(e.split()))
        parts = [p.strip() for p in c.split(",") if p.strip()]
        out += [", ".join(parts[-2:]), parts[-1]] if len(parts) > 1 else []
    for t in (title or "", (text or "")[:2000]):
        for p in gazetteer.CUES:
            out += [", ".join(g.strip() for g in m.groups() if g) for m in re.finditer(p, t)]
    context = f"{title or ''} {(text or '')[:2000]}".lower()
    for country in gazetteer.COUNTRIES:
        if country.lower() in context:
            out += [f"{q}, {country}" for q in queries or [] if q and country.lower() not in q.lower()]
    seen, kept = set(), []
    for v in map(strip, out):
        if v and v.lower() not in seen:
            seen.add(v.lower())
            kept.append(v)
    return kept[:most]


def test_place_variants_against_a_loop(spark):
    rng = random.Random(11)
    words = [p for p, _ in gazetteer.KNOWN_PLACES] + ["Shelf", "continental shelf", "offshore", "SW", "NE", "WA", "NSW", ",", ".", "–", "site", "core 12", "Bay", "A12", "xx"]
    texts = ["", None, "Cores near Port Elin, and offshore of Cape Nord on the shelf. Wreck Bay, Australia", "of Great Head, Tasmania and near Robe", "South Africa, Malta near Taiwan", "x" * 3000 + " Malta"]
    rows = [(i, rng.choice([None, [], [rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 5)))]) for _ in range(rng.randrange(1, 4))]]), rng.choice(texts), rng.choice(texts), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, queries array<string>, title string, text string, known string")
    for most in (None, 8):
        got = {r["id"]: r["variants"] for r in gazetteer.query_variants(df, most=most).collect()}
        for i, queries, title, text, _ in rows:
            assert got[i] == plain_variants(queries, title, text, most), (queries, title, text)


def test_phrases_of_a_dictionary(spark):
    rng = random.Random(2)
    entries = [("".join(rng.choices("ab ", k=rng.randrange(1, 5))), (f"v{i}",)) for i in range(80)]
    texts = ["".join(rng.choices("abAB c", k=rng.randrange(30))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in gazetteer.named(df, "text", entries).collect():
        low = (r["text"] or "").lower()
        assert r["known"] == [v for p, values in entries for v in values if p in low]
    with pytest.raises(ValueError):
        gazetteer.named(df, "text", [("x" * (33 << 20), ())])


def test_best_place_rules(spark):
    base = ("place", "town", 0.5, 1.0, 2.0)
    rows = [
        ("Robe", "Robe, Australia", *base, "city", "", 0), ("Robe", "Robe Road, Australia", *base[:2], 0.9, 1.0, 2.0, "road", "", 1), ("Robe", "Robe, Texas", *base[:2], 0.8, 1.0, 2.0, "city", "", 2),
        ("Bay", "Bay, Norge", *base, "city", "Wells of the North Sea", 4), ("Bay", "Bay, Denmark", *base, "city", "Wells of the North Sea", 3), ("Bay", "Bay, Spain", *base[:2], 0.9, 1.0, 2.0, "city", "Wells of the North Sea", 2), ("Gozo", "Gozo, Malta, New York", *base, "city", "Malta", 0),
    ]
    df = spark.createDataFrame(rows, "query string, display_name string, class string, type string, importance double, lat double, lon double, addresstype string, text string, seq int")
    df = df.selectExpr("*", "CASE WHEN query = 'Robe' THEN 'Shelf of South Australia' END AS title")
    assert {r["query"]: r["display_name"] for r in gazetteer.best_place(df).collect()} == {"Robe": "Robe, Australia", "Bay": "Bay, Denmark"}


# --- interpretation


def test_stages_and_what_stays_open(spark):
    docs = [
        ("s1", "Report", "A raised beach at 10.5000, 20.2500, with a water depth of 12 m."), ("s2", "Report", "table of atoll, guyot and mangrove"), ("s3", "Chapter", "A chapter of a story"), ("s4", None, None),
        ("s5", "Permian conodont beds", "Table of Permian sedimentology"), ("s6", "R", "# Reefs\n\nThe ridge has a water depth of 30 m.\n\nThe terrace has a depth of 30.4 m.\n\nA raised beach stands at 10 feet."), ("s7", "R", "none"),
    ]
    d = spark.createDataFrame(docs, "source_id string, title string, text string")
    blocks = spark.createDataFrame([("s7", 3, "map", "Map 3", "A map near Port Elin with a submerged forest at depth of 4 m"), ("s7", 1, "image", "Fig", " "), ("zz", 1, "map", "x", "near Port Elin"), ("s1", 1, "table", "T", "depth"), ("s1", 2, "table", "T", "depth")], "source_id string, page int, source string, cue string, text string")
    items = spark.createDataFrame([], "source_id string, table_no int, caption string, html string")
    answers = spark.createDataFrame([(s, "m1", 1.0, 2.0) for s in ("s1", "s2", "s3", "s5")], "source_id string, sample_id string, latitude double, longitude double")
    places = spark.createDataFrame([("Port Elin", 5.0, 6.0)], "query string, lat double, lon double")
    link = spark.createDataFrame([("s1", "https://doi.org/10.1/x")], "source_id string, url string")
    out = documents.interpreted(d, blocks, items, answers, link, places)
    got = sorted((r["source_id"], r["stage"], r["indicator_type"], r["elevation_m"]) for r in out.records.collect())
    assert [g for g in got if g[1] != "narrative"] == [("s1", "document", "raised_beach", -12.0), ("s2", "model", None, None), ("s7", "page_block", "terrestrial_over_marine_contact", -4.0)]
    assert sorted(g[3] for g in got if g[0] == "s6") == [-30.4, -30.0, 3.05]  # open: all of them
    assert {r["doi_or_url"] for r in out.records.collect() if r["source_id"] == "s1"} == {"https://doi.org/10.1/x"}
    assert {r["source_id"]: r["class"] for r in out.unresolved.collect()} == {"s3": "non_candidate_narrative_source", "s4": "non_candidate_unstructured_source", "s5": "non_candidate_unstructured_source"}
    assert sorted((r["source_id"], r["n"], r["label"]) for r in out.contexts.collect()) == [("s1", 1, "table page 1: T"), ("s7", 1, "map page 3: Map 3")]
    s = {r["source_id"]: r for r in out.summary.collect()}
    assert len(s) == 7 and s["s5"]["ancient"] and s["s2"]["artifacts"] and s["s1"]["coordinates"] == 1 and s["s4"]["text_length"] == 0 and s["s7"]["n_blocks"] == 2 and s["s7"]["n_contexts"] == 1
    empty = documents.interpreted(d.limit(0), blocks, items)
    assert empty.records.count() == empty.unresolved.count() == empty.summary.count() == 0


def test_equal_headers_keep_the_last_cell(spark):
    html = "<table><tr><td>A</td><td>B</td><td>a</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>5</td></tr></table>"
    got = {r["row"]: r["cells"] for r in extraction.table_records(spark.createDataFrame([(1, html)], "id long, html string"), "id").collect()}
    assert got == {1: {"a": "3", "b": "2"}, 2: {"a": "5"}}


def test_coordinates_and_indicators_far_in_a_text_count(spark):
    """A document and a page block whose coordinates, indicator and age stand beyond the first 40 000 characters give records."""
    far = "x y z " * 7000 + "\n\nA raised beach at 10.5000, 20.2500 with a water depth of 12 m, 9,250 years B.P."
    d = spark.createDataFrame([("s1", "Report", far), ("s2", "Report", "Permian conodont beds " + "x " * 3000 + "Holocene table"), ("s3", "Report", "none")], "source_id string, title string, text string")
    blocks = spark.createDataFrame([("s3", 1, "map", "Map 1", far)], "source_id string, page int, source string, cue string, text string")
    items = spark.createDataFrame([], "source_id string, table_no int, caption string, html string")
    answers = spark.createDataFrame([("s2", "m1", 1.0, 2.0)], "source_id string, sample_id string, latitude double, longitude double")
    out = documents.interpreted(d, blocks, items, answers)
    got = sorted((r["source_id"], r["stage"], r["indicator_type"], r["latitude"], r["age_ka"]) for r in out.records.filter("stage <> 'narrative'").collect())
    assert got == [("s1", "document", "raised_beach", 10.5, 9.25), ("s2", "model", None, 1.0, None), ("s3", "page_block", "raised_beach", 10.5, 9.25)]
    assert out.unresolved.count() == 0
