from helpers import EDGES, docs, edited, prose, rng, shingles
from pyspark.sql import functions as F


from pageloom.llm import neardup as N


def brute(rows):
    """Components by comparing all sets."""
    own = {}
    for i, t in rows:
        own.setdefault(i, set()).update(shingles(t))
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= 75 * (len(own[i]) + len(own[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(own[i]), top(i)) for i in ids}


def corpus():
    r = rng(5)
    rows, n = [], 0

    def add(text):
        nonlocal n
        n += 1
        rows.append((r.randrange(10**9), text))

    for _ in range(40):
        add(prose(r, r.randint(3, 200)))
    for _ in range(6):  # copies and near copies around the limit
        base = prose(r, 150)
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.06):
            add(edited(r, base, share))
    passage = prose(r, 60)  # many that share a passage, but little else
    for _ in range(30):
        add(passage + " " + prose(r, 50))
    base = prose(r, 120)
    for _ in range(60):  # a large group
        add(edited(r, base, 0.02))
    chain = prose(r, 100).split(" ")
    for i in range(12):  # a chain whose ends are not alike
        add(" ".join([*chain[4 * i :], *(f"q{j}" for j in range(4 * i))]))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    for small, heavy in ((8, N.HEAVY), (2, 3)):
        kept = N.SMALL, N.HEAVY
        N.SMALL, N.HEAVY = small, heavy
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs(spark, rows, "n", "node", "label")).collect()}
        finally:
            N.SMALL, N.HEAVY = kept
        assert got == want


def test_edges(spark):
    rows = [*EDGES, (30, "No Id here"), (31, "NO ID\there"), (32, "a b c d e f"), (33, "a b c d e f f")]
    got = N.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_shingles"], by[1]["component_id"], by[1]["kept"]) == (0, 1, True) and by[3]["component_id"] == 3
    assert by[31]["component_id"] == 30 and by[30]["kept"] and by[None]["component_id"] == 30 and not by[None]["kept"]
    assert by[6]["n_shingles"] == by[7]["n_shingles"] == 1 and by[33]["component_id"] == 33


def test_empty_and_alone(spark):
    assert N.near_duplicates(docs(spark, EDGES).limit(0)).count() == 0
    assert [tuple(r) for r in N.near_duplicates(docs(spark, [(7, "only one")])).collect()] == [(7, 1, 7, True)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select((F.col("id") * 7 % 199).alias("a"), ((F.col("id") + 1) * 7 % 199).alias("b"))
    assert {r["label"] for r in N.components(edges).collect()} == {0}


def test_copies_around_a_base_are_one_component(spark):
    r = rng(8)
    base = prose(r, 400)
    rows = [(i, edited(r, base, 0.0275)) for i in range(1, 2001)] + [(9999, base)]  # like the base, but not like each other
    own = shingles(base)
    near = [i for i, t in rows if 100 * len(own & shingles(t)) >= 75 * len(own | shingles(t))]
    assert len(near) > 1900
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(docs(spark, rows)).collect()}
    assert {got[i] for i in near} == {min(near)}


def test_what_is_left_is_compared_in_blocks(spark):
    kept = N.SMALL, N.BLOCK_SETS
    rows = corpus()
    want = brute(rows)
    try:
        N.SMALL, N.BLOCK_SETS = 1, 7
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(docs(spark, rows)).collect()}
    finally:
        N.SMALL, N.BLOCK_SETS = kept
    assert got == want


def around(size):
    """Copies of one text with up to 8 % of their words replaced: many pairs are near the limit."""
    r = rng(21)
    base = prose(r, 150)
    return [(i, edited(r, base, r.uniform(0.005, 0.08))) for i in range(size)]


def test_groups_near_the_limit_equal_brute_force_and_pairs_grow_in_proportion(spark):
    made, link = {}, N._Linker.link

    def counted(self, pairs):
        made[size] = made.get(size, 0) + pairs.count()
        return link(self, pairs)

    N._Linker.link = counted
    try:
        for size in (300, 600, 1200):
            rows = around(size)
            got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(docs(spark, rows)).collect()}
            assert got == brute(rows)
    finally:
        N._Linker.link = link
    assert made[1200] <= 4 * 1.15 * made[300]


def test_same_id_and_other_texts_are_documents_of_their_own(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "k l m n o p i j"
    rows = [(5, a), (5, b), (6, a), (6, b), (4, c), (5, c), (None, c), (None, "z z y y x x w w")]
    got = sorted((tuple(r) for r in N.grouped(docs(spark, rows)).select("doc_id", "component_id", "component").collect()), key=str)
    assert [x[:2] for x in got] == [(4, 4), (5, 4), (5, 5), (5, 5), (6, 5), (6, 5), (None, 4), (None, None)]
    assert len({x[2] for x in got}) == 4
    assert sum(r["kept"] for r in N.near_duplicates(docs(spark, rows)).collect()) == 4


def test_many_copies_of_one_text(spark):
    r = rng(3)
    text, kept = prose(r, 40), N.HEAVY
    rows = [(i, text) for i in range(300)] + [(1000 + i, prose(r, 40)) for i in range(50)] + [(2000, None)] * 100
    try:
        N.HEAVY = 20
        got = [tuple(x) for x in N.near_duplicates(docs(spark, rows)).collect()]
    finally:
        N.HEAVY = kept
    assert len(got) == len(rows) and all(x[2] == 0 for x in got if x[0] < 300) and all(x[2] == x[0] for x in got if x[0] >= 1000)
