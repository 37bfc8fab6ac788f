"""Concern maps, owners, ranked search with its cap, audits."""

import duckdb
import pytest

from lodestack.operators import documentation as DOC
from lodestack.operators import search as S
from lodestack.plans.documentation_queries import SQL, Q

MAP = """# Map
intro
| Concern | Canonical owner | Intent terms |
| --- | --- | --- |
| API Design | [api](docs/design/api.md) | interface rules; api |
| Storage | `docs/design/store.md` | |
| Old things | docs/design/gone.md, docs/archive/old.md | history |

after
"""


def test_map():
    m = DOC.parse_concern_map(MAP)
    assert m.state == "valid"
    assert {(k, t, p) for k, t, p, _ in m.rows} == {
        ("api-design", "api design", "docs/design/api.md"), ("api-design", "interface rules", "docs/design/api.md"), ("api-design", "api", "docs/design/api.md"), ("storage", "storage", "docs/design/store.md"),
        ("old-things", "old things", "docs/design/gone.md"), ("old-things", "history", "docs/design/gone.md"), ("old-things", "old things", "docs/archive/old.md"), ("old-things", "history", "docs/archive/old.md"),
    }
    assert DOC.parse_concern_map(None).state == "no_map" and DOC.parse_concern_map("no table").state == "no_map"
    for bad in ("../x.md", "/x.md", ""):
        assert DOC.parse_concern_map(f"| concern | canonical owner |\n|-|-|\n| a | {bad} |").state == "invalid"
    assert DOC.parse_concern_map("| concern | canonical owner |\n|-|-|\n|  | a.md |").state == "invalid"
    assert DOC.parse_concern_map("x" * 120_001).state == "invalid"


@pytest.fixture
def index(spark):
    rows = [("docs/design/api.md", "# API design\nrules of the interface"), ("docs/design/store.md", "---\nstatus: draft\n---\n# Store\napi notes"), ("docs/archive/old.md", "# Old\napi design api"), ("notes.md", "# Notes\nthe api and its design"), ("tests/fixtures/x/api.md", "# API design"), ("src/a.py", "api")]
    return spark.createDataFrame(rows, "path string, text string")


def test_ranked_search(spark, index):
    docs = DOC.docs_index(index)
    assert {r["path"]: r["title"] for r in docs.collect()} == {"docs/design/api.md": "API design", "docs/design/store.md": "Store", "docs/archive/old.md": "Old", "notes.md": "Notes"}
    tables = DOC.concern_tables(spark, DOC.parse_concern_map(MAP), index)
    got = DOC.ranked_search(docs, "api design", tables).orderBy("rank").collect()
    assert [r["path"] for r in got][0] == "docs/design/api.md" and got[0]["candidate_source"] == "fts_and_matched_owner" and got[0]["band"] == 0
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and not any(r["overflow"] for r in got)
    scoped = DOC.ranked_search(docs, "api design", tables, scope="docs/design").collect()
    assert {r["path"] for r in scoped} == {"docs/design/api.md", "docs/design/store.md"}
    over = DOC.ranked_search(docs, "api design", tables, cap=2).collect()
    assert len(over) == 1 and over[0]["overflow"] and over[0]["path"] is None
    assert DOC.ranked_search(docs, "zzz", tables).count() == 0 and DOC.ranked_search(docs, "", None).count() == 0
    shuffled = DOC.ranked_search(docs.repartition(5), "api design", tables).orderBy("rank").collect()
    assert shuffled == got


def test_owner_states(spark, index):
    tables = DOC.concern_tables(spark, DOC.parse_concern_map(MAP), index)
    got = {r["path"]: r["owner_state"] for r in tables["owners"].collect()}
    assert got == {"docs/design/api.md": "valid", "docs/design/store.md": "draft", "docs/design/gone.md": "missing", "docs/archive/old.md": "archived"}


def test_readiness():
    assert DOC.readiness("valid", "complete", "valid") == ("ready", None)
    assert DOC.readiness("invalid", "complete", "valid") == ("blocked", "request_repair") and DOC.readiness("valid", "blocked", "valid") == ("blocked", "environment_repair") and DOC.readiness("valid", "complete", "stale") == ("blocked", "refresh")


def test_audit(spark):
    docs = spark.createDataFrame([(f"{c}.md",) for c in "abcde"], "path string")
    f = spark.createDataFrame([("a.md", 1), ("a.md", 2), ("d.md", 1)], "path string, line int")
    pages = [DOC.audit(f, docs.repartition(3), s, 2).orderBy("path").collect() for s in (0, 2, 4)]
    assert [(r["path"], r["findings"]) for p in pages for r in p] == [("a.md", 2), ("b.md", 0), ("c.md", 0), ("d.md", 1), ("e.md", 0)]
    assert len({r["fingerprint"] for p in pages for r in p}) == 1 and [p[0]["more"] for p in pages] == [True, True, False]


def test_search_page_ranks_every_candidate(spark, tmp_path):
    """More hits than the public cap: the query pages through all of them, as its SQL does."""
    spark.range(16_800).selectExpr("id doc_id", "concat('a design note ', id, repeat(' more', cast(id % 7 as int))) text", "'en' lang", "'src1' source", "20L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q["docs_search_page"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.execute(SQL["docs_search_page"]).fetchall()
    assert sorted(got) == sorted(want) and len(got) == 3 and got[0][2] > S.CANDIDATES
