import random
from collections import Counter, defaultdict

from colloquy.llm.consensus import consensus, latest_votes
from colloquy.llm.grouped_splits import assign_splits, entity_groups, norm_ticker
from colloquy.llm.survivorship import canonical_resource, check_time, iso_utc, survivors


def groups(spark, edges):
    df = spark.createDataFrame(edges, "record string, entity string")
    return dict(tuple(r) for r in entity_groups(df).collect())


def test_groups_of_chains_and_nulls(spark):
    n = 40
    chain = [(f"r{i:03d}", f"e{i}") for i in range(n)] + [(f"r{i:03d}", f"e{i + 1}") for i in range(n)]
    random.Random(1).shuffle(chain)
    got = groups(spark, chain + [("x", None), ("x", None), (None, "e1"), ("y", "z"), ("y", None), ("w", "z")])
    assert {got[f"r{i:03d}"] for i in range(n)} == {"r000"}
    assert got["x"] == "x" and got["y"] == got["w"] == "w" and None not in got
    assert groups(spark, []) == {}


def test_groups_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"r{rnd.randrange(300)}", f"e{min(rnd.randrange(200), rnd.randrange(400))}") for _ in range(420)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        parent[find(("e", e))] = find(("r", r))
    low = defaultdict(list)
    for r in {r for r, _ in edges}:
        low[find(("r", r))].append(r)
    assert groups(spark, edges) == {r: min(v) for v in low.values() for r in v}


def test_tickers(spark):
    df = spark.createDataFrame([(" $abc ",), ("XEX: abc",), ("ABC",), ("",), (None,), ("$",)], "t string")
    assert [r[0] for r in df.select(norm_ticker(df.t)).collect()] == ["ABC", "ABC", "ABC", None, None, None]


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(2)
    sizes = [500, 60, 40] + [rnd.randrange(1, 6) for _ in range(600)]
    rows = [(f"g{i}", rnd.choice(["a", "a", "b", None]), k) for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "group string, label string, split_no int")
    out = assign_splits(df, ["train", "validation", "test"], [0.8, 0.1, 0.1]).collect()
    assert len(out) == len(rows)
    by = defaultdict(set)
    for r in out:
        by[r["group"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r["split"] for r in out)
    assert abs(share["train"] / len(rows) - 0.8) < 0.01 and abs(share["test"] / len(rows) - 0.1) < 0.01
    b = Counter(r["split"] for r in out if r["label"] == "b")
    assert abs(b["test"] / sum(b.values()) - 0.1) < 0.05
    assert assign_splits(df.limit(0), ["train", "test"], [0.5, 0.5]).collect() == []


def test_resources_and_times(spark):
    same = [
        ["https://ir.a.example/x/y?a=1&b=2", "HTTP://www.IR.A.example:80/x/y/?b=2&utm_source=m&a=1#top", " https://ir.a.example:443/x%2Fy?b=%32&a=1\n"],
        ["data/raw/c.txt", ".\\data\\raw\\c.txt", "data//raw/./c.txt", "data/./raw/c.txt\n", "data/raw/c.txt/"],
        ["https://b.example/a-b", "http://b.example/a%2Db/"],
    ]
    df = spark.createDataFrame([(g, s) for g, v in enumerate(same) for s in v] + [(9, ""), (9, None)], "g int, s string")
    got = defaultdict(set)
    for r in df.select("g", canonical_resource(df.s).alias("k")).collect():
        got[r.g].add(r.k)
    assert all(len(got[g]) == 1 for g in range(3)) and len({next(iter(v)) for v in got.values()}) == 4 and got[9] == {None}
    times = {
        "2024-03-01T10:00:00Z": "2024-03-01T10:00:00Z", "2024-03-01 10:00:00": "2024-03-01T10:00:00Z", "20240301T100000Z": "2024-03-01T10:00:00Z",
        "2024-03-01T10:00:00.999999Z": "2024-03-01T10:00:00Z", "2024-03-01T01:00:00+09:00": "2024-02-29T16:00:00Z", "2024-03-01": "2024-03-01T00:00:00Z",
        "1709287200": "2024-03-01T10:00:00Z", "01 Mar 2024": "2024-03-01T00:00:00Z", "9999-12-31": None, "0000-00-00": None, "pending": None,
        "2024-02-31": None, "": None, "2024-03-01T10:00:00-05:30": "2024-03-01T15:30:00Z",
    }
    df = spark.createDataFrame([(k,) for k in times] + [(None,)], "s string")
    assert {r[0]: r[1] for r in df.select("s", iso_utc(check_time(df.s))).collect()} == times | {None: None}


def test_survivors(spark):
    rows = [
        (3, "https://a.example/x", "Unknown", "2025-01-01", "web", "n3", 1),
        (1, "http://a.example/x/", "Open License", "2024-01-01", "manual", " ", 1),
        (2, "https://www.a.example/x", "restricted", "9999-12-31", "local_file", "n2", 1),
        (4, "b.txt", None, None, None, None, 1),
        (5, None, "restricted", "2024-01-01", "web", "x", 1),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, tier string, checked string, kind string, note string, _src int")
    run = lambda d: survivors(d, source="url", record_id="record_id", checked="checked", tier="tier", trust="kind", fields=["note"])
    got = {r.record_id: r for r in run(df.unionByName(df.limit(0))).collect()}
    assert set(got) == {1, 4}
    assert (got[1].n_records, got[1].tier, got[1].checked, got[1].note) == (3, "open_license", "2025-01-01T00:00:00Z", "n2")
    assert (got[4].tier, got[4].checked, got[4].note) == (None, None, None)
    assert run(df.limit(0)).collect() == []


def test_votes(spark):
    rows = [
        (1, "C1", "A", ["x", "x"], "2024-01-01T00:00:00Z"), (2, " c1", "a ", ["Y-z"], "2024-01-02T00:00:00Z"), (3, "c1", "a", [" "], "2024-01-03T00:00:00Z"),
        (4, "c1", "b", None, "2024-01-01T00:00:00Z"), (5, "c1", "b", [None, "", "q"], "bad time"), (6, None, "b", ["q"], None), (7, "c1", None, ["q"], None),
    ]
    df = spark.createDataFrame(rows, "id long, chunk string, who string, labels array<string>, t string")
    v = latest_votes(df, item="chunk", annotator="who", labels="labels", time="t", row_id="id")
    assert sorted(tuple(r) for r in v.collect()) == [("c1", "a", "y_z"), ("c1", "b", "q")]
    out, rel = consensus(v.limit(0))
    assert out.collect() == [] and rel.collect() == []


def test_consensus_beats_plain_votes(spark):
    rnd = random.Random(11)
    labels = ["a", "b", "c", "d"]
    good, bad = [f"g{i}" for i in range(5)], [f"z{i}" for i in range(8)]
    truth, votes = {}, []
    for i in range(400):
        y = truth[f"i{i}"] = rnd.choice(labels)
        for who in rnd.sample(good, 2) + rnd.sample(bad, 3):
            right = rnd.random() < (0.92 if who in good else 0.3)
            wrong = "a" if who == "z0" else rnd.choice([x for x in labels if x != y])
            votes.append((f"i{i}", who, y if right else wrong))
    out, rel = consensus(spark.createDataFrame(votes, "item string, annotator string, label string"))
    got = {r["item"]: r["label"] for r in out.collect()}
    by = defaultdict(Counter)
    for i, _, v in votes:
        by[i][v] += 1
    plain = sum(by[i].most_common(1)[0][0] == truth[i] for i in truth)
    mine = sum(got[i] == truth[i] for i in truth)
    assert mine > plain and mine > 0.9 * len(truth)
    r = {x["annotator"]: x["reliability"] for x in rel.collect()}
    assert min(r[g] for g in good) > max(r[z] for z in bad)
