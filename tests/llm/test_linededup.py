import duckdb
from pyspark.sql import functions as F

from predio.llm.linededup import boilerplate_lines, remove_shared_lines
from predio.llm.queries import OP3_SQL, op3_site_spread_lines


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_lines, n_removed, text from ({OP3_SQL})").fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in op3_site_spread_lines(spark, sf_dir).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = spark.range(200).selectExpr("explode(sequence(1, cast(id + 1 as int))) as site", "id as h1").selectExpr("h1", "h1 as h2", "cast(site as string) as site")
    got = {r.h1 for r in boilerplate_lines(rows.unionAll(rows), 100, lg_k=4).collect()}
    exact = {r.h1 for r in boilerplate_lines(rows, 100, lg_k=4, band=2.0).collect()}
    assert exact == set(range(99, 200))  # all that can be near are counted
    assert got >= set(range(150, 200))


def test_rows_equal_a_plain_loop(spark):
    """Copies of one text are one site; a null site is a site of its own; blank lines stay."""
    copies = [(i, "one text\non many sites", f"s{i}") for i in range(12)]
    menus = [(20 + i, f"menu here\n\nown line {i}", f"s{i}" if i else None) for i in range(8)]
    few = [(40 + i, f"rare line\nits own {i}", f"s{i}") for i in range(7)]
    both = [(60 + i, f"one text\nbesides {i}", f"t{i}") for i in range(7)]  # with the copies' one site, the eighth
    docs = [*copies, *menus, *few, *both, (80, None, "s1"), (81, "menu here", "s1")]
    site, sites = {}, {}
    for _, text, source in docs:
        site[text] = min(site.get(text, source or ""), source or "")
    for _, text, _ in docs:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).add(site[text])
    want = {i: text and "\n".join(x for x in text.split("\n") if not x or len(sites[x]) < 8) for i, text, _ in docs}
    got = {r.doc_id: r.text for r in remove_shared_lines(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == want
    assert got[0] == "on many sites" and got[20] == "\nown line 0" and got[40] == "rare line\nits own 0" and got[60] == "besides 0" and got[80] is None and got[81] == ""


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    out = remove_shared_lines(odd_docs, min_sites=2)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_removed"] and out.count() == odd_docs.count()
    assert rows[6].text == rows[1].text and rows[6].n_removed == 0  # equal texts, so one site
    assert rows[3].text is None and rows[2].text == "" and rows[7].text == "   \n\n \t"
    assert remove_shared_lines(no_docs).count() == 0
