"""Queries: links, places and titles of documents, and their interpretation as one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import documents, gazetteer, links
from tidemark.plans.evidence import _COORDINATES_SQL, notes
from tidemark.plans.extraction import _INDICATORS_SQL
from tidemark.plans.registry import query, table

_OWN = "\nCite this article as: https://doi. org/10.1016/\n  j.quascirev."


def _text(x):
    return x.cast("string")


@query("doi_links", f"""WITH s AS (SELECT doc_id, doc_id % 1000 + 1000 AS k, length(coalesce(text, '')) + {len(_OWN.replace('doi. org', 'doi.org').split('10.1016')[0])} AS pos FROM documents)
    SELECT doc_id AS source_id, CASE WHEN doc_id % 5 = 0 AND pos >= 5000 THEN '10.1016/S0277-3791(01)00' || CAST(k % 900 + 100 AS VARCHAR) || '-X' ELSE '10.1016/j.quascirev.' || CAST(k AS VARCHAR) || '.01.0' || CAST(doc_id % 9 AS VARCHAR) END AS doi,
        CASE WHEN doc_id % 5 = 0 AND pos >= 5000 THEN 'pdf_metadata_pii' ELSE 'text' END AS source, CASE WHEN doc_id % 5 = 0 AND pos >= 5000 THEN 110 ELSE CASE WHEN pos < 5000 THEN 90 WHEN pos < 20000 THEN 70 WHEN pos < 40000 THEN 45 ELSE 5 END + CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 70 END + 5 END AS score
    FROM s""")
def doi_links(spark, d):
    """Each document's own DOI, broken at slashes and full stops, against one among its references and the item identifier in the metadata of every fifth."""
    k = F.col("doc_id")
    number = k % 1000 + 1000
    own = F.concat(F.when(k % 5 == 0, F.lit(_OWN.replace("Cite this article as", "Xxxx xxxx xxxxxxx xx"))).otherwise(F.lit(_OWN)), _text(number), F.lit(".\n01.\t0"), _text(k % 9), F.lit(".\n"))
    refs = F.concat(F.lit("x " * 120 + "\n# References\nSomebody (2001) 10.5555/other-\n"), _text(number), F.lit(".7, and 10.99/short"))
    docs = table(spark, d, "documents")
    text = docs.select(k.alias("source_id"), F.lit(1).alias("seq"), F.lit("text").alias("source"), F.concat(F.coalesce("text", F.lit("")), own, refs).alias("text"))
    pii = docs.filter(k % 5 == 0).select(k.alias("source_id"), F.lit(0).alias("seq"), F.lit("pdf_metadata").alias("source"), F.concat(F.lit("Subject: PII: S0277-3791(01)00"), _text(number % 900 + 100), F.lit("-X ")).alias("text"))
    return links.source_links(text.unionByName(pii)).select("source_id", "doi", "source", "score")


_QUERIES = ("Mossel Bay, near SE Africa", "NW Malta – Gozo", "Rottnest Shelf WA", "Core 12", "Robe", "Torres Strait continental shelf")


@query("place_variants", """WITH c AS (SELECT c_custkey AS id, c_custkey % 6 AS k, c_custkey % 7 AS t FROM customer),
    q AS (SELECT id, t, ['Mossel Bay, near SE Africa', 'NW Malta – Gozo', 'Rottnest Shelf WA', 'Core 12', 'Robe', 'Torres Strait continental shelf'][k + 1] AS query,
        CASE k WHEN 0 THEN ['Mossel Bay, South Africa', 'Mossel Bay, near SE Africa', 'Mossel Bay, near southeast Africa', 'near SE Africa'] WHEN 1 THEN ['northwest Malta, Malta', 'Malta', 'Gozo, Malta', 'NW Malta - Gozo', 'northwest Malta - Gozo']
        WHEN 2 THEN ['Rottnest Island, Western Australia', 'Rottnest Shelf, Western Australia', 'Rottnest Shelf WA', 'Rottnest WA', 'Rottnest Shelf Western Australia'] WHEN 3 THEN [] WHEN 4 THEN ['Robe, South Australia', 'Robe']
        ELSE ['Torres Strait, Queensland, Australia', 'Torres Strait continental shelf', 'Torres Strait', 'Torres Strait continental'] END AS v FROM c)
    SELECT id, list_concat(v, CASE WHEN t < 2 THEN ['Port Elin', 'Elin Bay, South Africa'] WHEN t = 2 THEN ['Cape Nord'] ELSE [] END, CASE WHEN t < 2 THEN [query || ', South Africa'] WHEN t = 2 AND NOT contains(lower(query), 'malta') THEN [query || ', Malta'] ELSE [] END)[1:8] AS variants FROM q""")
def place_variants(spark, d):
    """The spellings under which every customer's place is looked up: known places, abbreviations, cues and countries of the context; eight at most, the look-up's rule."""
    k, t = F.col("c_custkey") % 6, F.col("c_custkey") % 7
    q = F.element_at(F.array(*(F.lit(x) for x in _QUERIES)), (k + 1).cast("int"))
    text = F.when(t < 2, "Cores near Port Elin, from Elin Bay, South Africa").when(t == 2, "Dredged near Cape Nord. Malta").otherwise("nothing said")
    return gazetteer.query_variants(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(q).alias("queries"), F.lit("Report").alias("title"), text.alias("text")))


@query("gazetteer_context", """WITH g AS (SELECT n_name AS query, s_suppkey AS k, s_name || ', ' || n_name || CASE s_suppkey % 4 WHEN 0 THEN ', Malta' WHEN 1 THEN ', Malta, New York' WHEN 2 THEN ', Norway' ELSE '' END AS display_name, CASE s_suppkey % 3 WHEN 0 THEN 'road' ELSE 'town' END AS addresstype, s_acctbal AS importance, n_nationkey % 3 AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT query, arg_max(display_name, importance) AS display_name FROM g WHERE addresstype <> 'road' AND (c <> 0 OR k % 4 = 0) AND (c <> 1 OR k % 4 = 2) GROUP BY query""")
def gazetteer_context(spark, d):
    """The choice among gazetteer results by address type and by what the context asks for."""
    k = F.col("s_suppkey")
    g = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("query"), F.concat("s_name", F.lit(", "), "n_name", F.when(k % 4 == 0, ", Malta").when(k % 4 == 1, ", Malta, New York").when(k % 4 == 2, ", Norway").otherwise("")).alias("display_name"), F.when(k % 3 == 0, "road").otherwise("town").alias("addresstype"),
        F.lit("place").alias("class"), F.lit("town").alias("type"), F.col("s_acctbal").alias("importance"), F.when(F.col("n_nationkey") % 3 == 0, "Caves of Malta").otherwise("Report").alias("title"), F.when(F.col("n_nationkey") % 3 == 1, "Wells in the North Sea").otherwise("").alias("text"))
    return gazetteer.best_place(g).select("query", "display_name")


@query("clean_titles", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'A title of its own' WHEN 1 THEN 'Notes on a raised beach near port ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN 'y y and a guyot far out, number ' || CAST(doc_id AS VARCHAR) WHEN 3 THEN 'Sections And Samples Of Hole ' || CAST(doc_id AS VARCHAR) ELSE 'file_' || CAST(doc_id AS VARCHAR) END AS title FROM documents""")
def clean_titles(spark, d):
    """The rungs of the title ladder: the title, a line with a title's words, the text around them, a line that looks like a title, the file's name."""
    k = F.col("doc_id")
    stem = F.concat(F.lit("file_"), _text(k))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[A-Z\r\n]", " "), "beach|guyot|terrace|forest|mount|platform", " "))
    title = F.when(k % 5 == 0, "  A title  of its own ").when(k % 5 == 1, "PII: S1").when(k % 5 == 2, "").when(k % 5 == 3, "Terms of use").otherwise(stem)
    text = (
        F.when(k % 5 == 1, F.concat(F.lit("x\nNotes on a  raised beach near port "), _text(k), F.lit("\n"), plain)).when(k % 5 == 2, F.concat(F.lit("y\n" * 25 + "and a guyot far out, number "), _text(k)))
        .when(k % 5 == 3, F.concat(F.lit("z\nSections And Samples Of Hole "), _text(k), F.lit("\n"), plain)).otherwise(plain)
    )
    return table(spark, d, "documents").select("doc_id", tx.clean_title(title, text, stem).alias("title"))


def _interpretation(spark, d):
    """Notes of two thirds of the documents and the bare texts of the others, with a block for every fourth, a table for every fifth and answers of a model for every second."""
    n = notes(spark, d).select("doc_id", "note")
    k = F.col("doc_id")
    docs = table(spark, d, "documents").join(n, "doc_id").select(k, F.concat(F.lit("d"), _text(k)).alias("source_id"), F.lit("Report off Cape Nord").alias("title"), F.when(k % 3 > 0, F.col("note")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" and a Table"))).alias("text"))
    blocks = docs.filter(k % 4 == 0).select("source_id", F.lit(2).alias("page"), F.lit("table").alias("source"), F.lit("Table 1").alias("cue"), F.concat(F.lit("A submerged beach at a depth of 12 m lies at "), _text(k % 80), F.lit(".5000, 20.2500, "), _text(k)).alias("text"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>"))), F.lit("</tr>"))
    items = docs.filter(k % 5 == 0).select("source_id", F.lit(1).alias("table_no"), F.lit(None).cast("string").alias("caption"), F.concat(F.lit("<table>"), row("Location", "Feature type", "Depth range (m)", "a", "b", "Reference"), row(F.concat(F.lit("Loc "), _text(k)), "Terrace", "7 m", "x", "y", "ref"), F.lit("</table>")).alias("html"))
    answers = docs.filter(k % 2 == 0).select("source_id", F.lit("model_1").alias("sample_id"), F.concat(F.lit("Cove "), _text(k)).alias("site_name"), F.lit("raised_beach").alias("indicator_type"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    told = docs.filter(k % 7 == 0).select("source_id", F.concat(F.lit("https://doi.org/10.1000/"), _text(k)).alias("url"))
    return documents.interpreted(docs.drop("doc_id"), blocks, items, answers, told)


_PARTS_SQL = f"""WITH {_COORDINATES_SQL}, k AS (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS source_id, doc_id % 3 > 0 AND lat IS NOT NULL AND lon IS NOT NULL AS located, lower(substr(note, 1, 6000)) AS head FROM located), f AS (SELECT *, CASE WHEN located THEN greatest(1, len({_INDICATORS_SQL})) ELSE 0 END AS n_document FROM k),
    m AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_page_block, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_table FROM f), a AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND n_document + n_page_block + n_table = 0 THEN 1 ELSE 0 END AS n_model FROM m)"""

#: The same of whole texts, for the queries that count records.
_WHOLE_SQL = _PARTS_SQL.replace("substr(note, 1, 20000)", "note").replace("substr(note, 1, 6000)", "note")


@query("interpretation_records", f"{_WHOLE_SQL} SELECT source_id, n_document::BIGINT AS n_document, n_page_block::BIGINT AS n_page_block, n_table::BIGINT AS n_table, n_model::BIGINT AS n_model FROM a")
def interpretation_records(spark, d):
    """How many records each document gives at each stage before the last resort."""
    return _interpretation(spark, d).summary.select("source_id", "n_document", "n_page_block", "n_table", "n_model")


@query("interpretation_unresolved", f"{_WHOLE_SQL} SELECT source_id FROM a WHERE n_document + n_page_block + n_table + n_model = 0 AND doc_id % 3 = 0")
def interpretation_unresolved(spark, d):
    """Documents that stay without a record."""
    return _interpretation(spark, d).unresolved.select("source_id")


@query("interpretation_contexts", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS source_id, 1 AS n, 'table page 2: Table 1' AS label FROM documents WHERE doc_id % 4 = 0")
def interpretation_contexts(spark, d):
    """What a model would be asked about."""
    return _interpretation(spark, d).contexts.select("source_id", "n", "label")


@query("interpretation_links", f"{_PARTS_SQL} SELECT source_id, CASE WHEN doc_id % 7 = 0 THEN 'https://doi.org/10.1000/' || CAST(doc_id AS VARCHAR) END AS doi_or_url FROM a WHERE n_table > 0")
def interpretation_links(spark, d):
    """The links that records of tables get from their sources."""
    return _interpretation(spark, d).records.filter("stage = 'table'").select("source_id", "doi_or_url")
