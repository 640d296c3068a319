"""One small test for each finding of round 5 that was mended."""

import numpy as np
import pyarrow as pa

from folium.llm import near_dedup
from folium.operators import alignment, content, labels, markup
from folium.sources import documents as sources


def test_the_second_round_goes_back_to_html(spark, monkeypatch):
    read = []
    monkeypatch.setattr(alignment.D, "nodes", lambda df, id, value, kind="html", f=alignment.D.nodes, **x: read.append((value, kind)) or f(df, id, value, kind, **x))
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b</p><ul><li>c</li></ul>"), (2, "")], "page_id long, html string")
    found = alignment.fidelity_lines(pages, "page_id", "html").collect()
    assert read.count(("body", "html")) == 2 and read.count(("content", "docx")) == 1
    assert sorted((r["stage"], r["line"], r["fate"]) for r in found) == [(s, line, "kept") for s in ("again", "back", "package") for line in "abc"]


def test_no_side_of_a_fold_is_broadcast(spark, monkeypatch):
    plans = []
    said = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (labels, markup):
        monkeypatch.setattr(module, "cut", lambda df, name, f=module.cut: said(df) or f(df, name))
    html = '<style>.a::marker { content: "4." counter(list-item) ") " }</style><ol><li class="a">x<ol><li>y</li></ol></li></ol><table><tr><th>z</th></tr></table>'
    nodes = sources.nodes(sources.to_docx(spark.createDataFrame([(1, html), (2, "<p>b</p>")], "k long, html string"), "k", "html"), "doc_id", "content", "docx")
    said(markup.nodes_to_docx(labels.cut(nodes, "nodes")))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_children_of_a_batch_are_held_in_parts():
    automata = content.compiled()
    items = [{"pos": p, "name": ("w:b", "w:rStyle", "w:bar")[p % 3]} for p in range(1, 1025)]
    kinds = {"k": pa.int64(), "parent": pa.string(), "state": pa.int32(), "last": pa.bool_(), "items": pa.list_(pa.struct([("pos", pa.int32()), ("name", pa.string())]))}
    batch = pa.RecordBatch.from_pylist([{"k": k, "parent": "w:rPr", "state": 0, "last": True, "items": items if k else []} for k in range(200)], pa.schema(list(kinds.items())))
    parts = list(content._replayed(automata, iter([batch])))
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= content.ITEMS
    rows = pa.Table.from_batches(parts).to_pylist()
    first = [(r["pos"], r["name"], r["fault"]) for r in rows if r["k"] == 1]
    assert {r["k"] for r in rows} == set(range(1, 200)) and all([(r["pos"], r["name"], r["fault"]) for r in rows if r["k"] == k] == first for k in (2, 63, 64, 65, 199))
    assert first[:4] == [(2, "w:bar", "unknown"), (4, "w:rStyle", "misplaced"), (5, "w:bar", "unknown"), (6, "w:b", "repeated")]


def test_fingerprints_of_many_sets_are_counted_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 2, 254, 255, 256, 0, 511, 4097, 70_000, 7, 0)] + [np.full(600, 2**64 - 1, np.uint64)]

    def plain(hashes):
        out = []
        for _ in near_dedup.PRINT:
            out.append(sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes)))
            hashes = near_dedup._again(hashes)
        return out

    calls = []
    monkeypatch.setattr(near_dedup, "_again", lambda h, f=near_dedup._again: calls.append(len(h)) or f(h))
    found = near_dedup.fingerprints(sets)
    assert len(calls) < len(near_dedup.PRINT) * 6 and sum(calls) == len(near_dedup.PRINT) * sum(map(len, sets))
    assert found.tolist() == [plain(x) for x in sets] and near_dedup.fingerprints([]).shape == (0, len(near_dedup.PRINT))
