import hashlib
import re

from stripewise.llm.common import cut
from stripewise.llm.exact_dedup import digests, drop_copies, exact_dedup, merged_runs


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0, i))
    out = []
    for i, t in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[plain])
        out.append((i, best[3], len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for fan_in in (2, 8):
        got = exact_dedup(awkward, fan_in=fan_in).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
        per_group = {}
        for r in got:
            per_group[r.text_sha256] = per_group.get(r.text_sha256, 0) + r.kept
        assert set(per_group.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_columns_and_one_row_a_group(awkward, empty):
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in awkward.collect()})
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_many_runs_and_a_hot_group(spark, docs_of):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}", "a") for i in range(600)]
    got = exact_dedup(docs_of(rows, parts=23), fan_in=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute([r[:2] for r in rows])


def test_a_round_is_one_exchange_and_one_sort(docs_of):
    """The runs of 23 tasks, two at a time: five rounds; the first also makes the runs."""
    found = cut(digests(docs_of([(i, f"text {i}", "a") for i in range(100)], parts=23)))
    assert found.agg({"run": "max"}).first()[0] == 22
    plan = merged_runs(found, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 5
    assert plan.count("Sort [") == 6 and "Python" not in plan and "Pandas" not in plan
