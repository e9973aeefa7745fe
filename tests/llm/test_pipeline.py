"""The pipeline stage by stage: each stage's rows from its predecessor's, against brute force."""

import corpus_pipeline as P
from airfill.llm import fertility, packing, pii
from airfill.llm.runtime import keyed
from airfill.session import written
from tests.llm.helpers import SF, edge_docs, empty_docs, prose, table, texts
from tests.llm.test_bpe_packing import check_pieces
from tests.llm.test_dedup import brute_groups
from tests.llm.test_quality import brute_base


def stages(spark, docs):
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check(spark, docs):
    start, good, once, apart, private, packed = stages(spark, docs)
    for df in (good, once, apart, private):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    passes = [(i, t) for i, t in pairs(start) if not brute_base(t)[-1]]
    verdict = {r["doc_id"] for r in fertility.rules(start).where("kept").collect()}
    assert sorted(map(repr, pairs(good))) == sorted(repr((i, t)) for i, t in passes if i in verdict)
    best = {}
    for i, t in pairs(good):
        if lower(t) not in best or (i is not None and (best[lower(t)][0] is None or i > best[lower(t)][0])):
            best[lower(t)] = (i, t)
    assert sorted(map(repr, pairs(once))) == sorted(map(repr, best.values()))
    rows = pairs(once)
    stay = {least for _, _, least in brute_groups(rows)}
    assert sorted(repr(x) for x in pairs(apart)) == sorted(repr(x) for x in rows if x[0] in stay)
    field = pii.trained(keyed(apart))
    want = [(i, t if t is None else pii.redact(t, pii.found_spans(t, field)[1])) for i, t in pairs(apart)]
    assert sorted(map(repr, pairs(private))) == sorted(map(repr, want))
    again = packing.pack(private, with_ids=True).collect()
    check_pieces(again, pairs(private))
    assert packed.count() == len(again)


def test_pipeline_of_the_table(spark):
    check(spark, table(spark, "documents"))


def test_pipeline_of_awkward_rows(spark):
    rows = [(i, t) for i, t in texts() if i is not None] + [(200 + k, prose(60 + k % 7)) for k in range(40)]
    check(spark, edge_docs(spark, rows).repartition(3))


def test_pipeline_of_rows_without_an_id(spark):
    """They are documents like any other; of equal texts a row with an id goes before one without."""
    mail = "write joe.smith@example.org now " + prose(93)
    rows = [(None, prose(90)), (None, prose(90)), (None, prose(91)), (5, prose(91).replace("e", "E")), (6, prose(92)), (None, mail), (None, None)]
    _, good, once, apart, private, packed = stages(spark, edge_docs(spark, rows).repartition(3))
    assert sorted(map(repr, pairs(good))) == sorted(map(repr, rows[:6]))
    left = [(None, prose(90)), rows[3], rows[4], rows[5]]
    assert sorted(map(repr, pairs(once))) == sorted(map(repr, pairs(apart))) == sorted(map(repr, left))
    redacted = [*left[:3], (None, mail.replace("joe.smith@example.org", "<EMAIL>"))]
    assert sorted(map(repr, pairs(private))) == sorted(map(repr, redacted))
    got = packed.collect()
    assert {r["doc_id"] for r in got} == {None, 5, 6} and sum(r["start"] == 0 for r in got) == 4
    whole = {(r["doc_id"], r["doc_tokens"]) for r in got}
    assert sum(r["length"] for r in got) == sum(n for _, n in whole)


def test_pipeline_of_no_rows(spark):
    assert stages(spark, empty_docs(spark))[-1].count() == 0


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "pii", "packing"]
