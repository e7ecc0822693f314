"""Jaccard join, decontamination and license scans."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import decontam, jaccard, licenses

DOCS = "doc_id long, text string, node long, chunk_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], DOCS).repartition(3)


def brute(rows, n, percent):
    """(doc_id, set size, component) by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(rng, sizes, per, edits):
    rows, i = [], 1
    for size in sizes:
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(per):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(words)) if words else 0
                words[k:k + 1] = rng.choice([[], [f"e{rng.randint(0, 9)}"], [*words[k:k + 1], "more"]])
            rows.append((i, rng.choice([" ", "\n"]).join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("n,percent,all_pairs", [(3, 90, 16), (3, 90, 3), (5, 80, 4), (2, 50, 3)])
def test_components_equal_all_pairs(spark, n, percent, all_pairs):
    rng = random.Random(n * percent + all_pairs)
    rows = corpus(rng, (2, 4, 9, 30, 100, 240), 30, 6)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "z " * 4000), (1006, "z " * 9000)]
    rows += [(2000 + i, "same text here every time") for i in range(40)] + [(2000, "same text here every time")]
    got = jaccard.join(docs_of(spark, rows), n=n, percent=percent, all_pairs=all_pairs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, percent)


def test_nulls_and_nothing(spark):
    got = jaccard.join(docs_of(spark, [(None, "a b c d"), (3, None), (None, None)]), n=3, percent=90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 0, "3"), ("None", 0, "None"), ("None", 2, "None")]
    assert jaccard.join(docs_of(spark, []), n=3).count() == 0


def test_kept_documents_come_back_whole(spark):
    rows = [(9, "the very same words as ever before"), (4, "the very same words as ever before"), (5, "something else that nobody wrote"), (6, None), (7, "")]
    kept = jaccard.Join(docs_of(spark, rows), carry=("node", "chunk_id")).kept().collect()
    assert sorted((r.doc_id, r.text or "", r.node, r.chunk_id) for r in kept) == [(4, rows[1][1], 5, "x"), (5, rows[2][1], 5, "x"), (6, "", 5, "x"), (7, "", 5, "x")]


ITEM = "If a train leaves Paris at 9 and travels 120 km in 3 hours how fast does the train of Anna go on average that day"


def leaks(spark, rows, items=((1, ITEM), (2, None), (3, "too short"))):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, rows), bench).collect())


def test_leaks_verbatim_and_with_other_values(spark):
    other = ITEM.replace("120", "345").replace("Paris", "Rome").replace("Anna", "Bertha").replace("3 hours", "7 hours")
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(1, f"{noise} {ITEM} {noise}"), (2, other), (3, noise), (4, None), (5, ""), (None, ITEM), (6, f"{noise}\n" * 400 + other), (1, noise)]
    assert leaks(spark, rows) == [(1, 1), (2, 1), (6, 1)]
    got = {r.doc_id: r for r in decontam.leaks(docs_of(spark, rows), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert got[1].changed == 0 and 0.3 < got[2].changed < 1 and got[2].consistency == 1
    kept = decontam.clean(docs_of(spark, rows), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "None"] and kept.columns == ["doc_id", "text", "node", "chunk_id"]


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 red apples then 5 green pears then 5 blue plums then 5 old figs then 5 new dates and count them all"
    mixed = item
    for n in ("1", "2", "3", "4", "6"):
        mixed = mixed.replace("5", n, 1)
    assert leaks(spark, [(1, mixed), (2, item.replace("5", "8"))], ((1, item),)) == [(2, 1)]


def test_leaks_in_another_case(spark):
    other = ITEM.replace("120", "345").replace("3 hours", "7 hours")
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.title()), (4, other.upper()), (5, other.lower()), (6, "NOTHING " * 40), (7, ITEM)]
    want = [1, 2, 3, 4, 5, 7]
    nouns = "wer hat im Garten von Anna den Baum mit den Blumen gesehen und wie viele Blumen standen im Garten bei dem Baum"
    assert leaks(spark, rows) == [(i, 1) for i in want]
    assert leaks(spark, rows, ((1, ITEM.upper()), (2, ITEM.lower()))) == [(i, k) for i in want for k in (1, 2)]
    assert leaks(spark, [(1, nouns.upper()), (2, nouns.lower()), (3, nouns)], ((1, nouns),)) == [(1, 1), (2, 1), (3, 1)]


def test_a_run_of_words_is_a_leak(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ban", "den", "fil", "gor", "hus", "jam", "kel", "lin", "mos", "nap")]
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    part = lambda a, n: f"{noise} {' '.join(words[a:a + n])} {noise}"
    slots = "take 5 red apples then 5 green pears then 5 blue plums then 5 old figs then count all of them " + " ".join(words)
    mixed = "take 1 red apples then 2 green pears then 3 blue plums then 4 old figs"
    rows = [(1, part(20, 13)), (2, part(20, 12)), (3, part(0, 13)), (4, part(20, 8) + part(40, 8)), (5, part(20, 13).upper())]
    assert leaks(spark, rows, ((1, " ".join(words)),)) == [(1, 1), (3, 1), (5, 1)]
    assert leaks(spark, [(1, mixed), (2, mixed.translate(str.maketrans("1234", "8888")))], ((1, slots),)) == [(2, 1)]


def test_short_and_slot_heavy_items(spark):
    items = ((1, "how far is the moon"), (2, "Add 3 to 4 then to 5"), (3, "At 7 Anna gave 12 to Bob and 15 to Carl and 9 to Dora at 8"), (4, "no"))
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(1, f"{noise} how far is the moon {noise}"), (2, "HOW FAR IS THE MOON"), (3, f"{noise} how far is the sun"), (4, f"{noise} no"),
            (5, "Add 12.5 to 1,250 then to 5"), (6, "At 7.5 Eva gave 1,200 to Fred and 15 to Gus and 9 to Hal at 8"), (7, noise)]
    assert leaks(spark, rows, items) == [(1, 1), (2, 1), (5, 2), (6, 3)]


def test_other_column_names(spark):
    docs = spark.createDataFrame([("7", ITEM, 1), ("8", "something else", 2)], "name string, body string, item_id int")
    bench = spark.createDataFrame([(1, ITEM)], "no long, question string")
    got = decontam.leaks(docs.withColumnRenamed("body", "question"), bench, id_col="name", item_col="no", text_col="question").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(7, 1)]
    kept = decontam.clean(docs.withColumnRenamed("body", "question"), bench, id_col="name", item_col="no", text_col="question")
    assert [r.name for r in kept.collect()] == ["8"] and kept.columns == ["name", "question", "item_id"]


def test_leaks_of_nothing(spark):
    assert leaks(spark, []) == [] and leaks(spark, [(1, ITEM)], ()) == []


def test_shuffled_benchmark_gives_the_same(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontam.leaks(docs_of(spark, [(1, ITEM)]), bench, broadcast_rows=0).count() == 1


def contained(text, template):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    a, b = grams(words(text)), grams(words(template))
    return len(a & b) / len(b)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        body = [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            notice = rng.choice(list(licenses.TEMPLATES.values())).split()
            if i % 2 and len(notice) > 8:
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randint(0, len(body))
            body[at:at] = notice
        rows.append((i, " ".join(body)))
    rows += [(900, None), (901, ""), (902, "MIT"), (None, licenses.TEMPLATES["mit"]), (903, "Released under the MIT License. " * 3000)]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(docs_of(spark, rows)).collect()}
    want = {(i, k): contained(t, v) for i, t in rows if t and i is not None for k, v in licenses.TEMPLATES.items() if contained(t, v) >= 0.8}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 40
    assert got == pytest.approx({k: want[k] for k in got})
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_edited_copies_and_parts_of_licences_are_retrieved(spark):
    """Recall of the bands, measured on passages with words changed, inside other text, at every offset."""
    rng = random.Random(5)
    rows, i = [], 0
    for name, body in licenses.TEMPLATES.items():
        for _ in range(12):
            own = body.split()
            for _ in range(rng.randint(0, max(len(own) // 25, 0))):
                own[rng.randrange(len(own))] = "changed"
            noise = lambda: [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 30))]
            rows.append((i, " ".join([*noise(), *own, *noise()])))
            i += 1
    got = {(r.doc_id, r.license) for r in licenses.scan(docs_of(spark, rows)).collect()}
    want = {(i, k) for i, t in rows for k, v in licenses.TEMPLATES.items() if contained(t, v) >= 0.8}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 400
    two = licenses.scan(docs_of(spark, rows + rows), broadcast_rows=0).collect()
    assert {(r.doc_id, r.license) for r in two} == got and len(two) == len(got)


def twins(n=1024):
    """Two words that sums of powers modulo 2^64 cannot tell apart: a Thue-Morse sequence and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_words_do_not_link(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z")]
    got = jaccard.join(docs_of(spark, rows), n=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(1, 5)]


def test_null_ids_keep_groups_apart(spark):
    x, y, z = "one two three four", "five six seven eight", "none of these has an id"
    rows = [(None, x), (5, x), (None, y), (6, y), (None, z), (None, z), (-2**63, "the least id of all")]
    join = jaccard.Join(docs_of(spark, rows), n=3, percent=90)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in join.documents().collect())
    assert got == sorted([("None", "5"), ("5", "5"), ("None", "6"), ("6", "6"), ("None", "None"), ("None", "None"), (str(-2**63), str(-2**63))])
    assert sorted((str(r.doc_id), r.text) for r in join.kept().collect()) == sorted(
        [("5", x), ("6", y), ("None", z), (str(-2**63), rows[-1][1])])


@pytest.mark.parametrize("percent", [80, 90])
def test_large_groups_with_members_apart(spark, percent):
    """Chains around hubs: members that link with others but not with the hub, and unlike texts with one line in common."""
    rng = random.Random(percent)
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(70):
        words = list(base)
        at, n = rng.randrange(60), rng.choice([0, 1, 1, 2, 3, 6, 9])
        words[at:at + n] = [f"c{at}"] * n
        rows.append((i, " ".join(words)))
    line = [f"line{k}" for k in range(14)]
    rows += [(100 + i, " ".join([f"own{i}k{k}" for k in range(40)] + line)) for i in range(60)]
    rows += [(200 + i, " ".join([f"own{i}k{k}" for k in range(40)] + line + ["end"])) for i in range(0, 60, 7)]
    got = jaccard.join(docs_of(spark, rows), n=3, percent=percent, all_pairs=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, percent)


def test_sketches_bound_the_difference():
    sketches = jaccard.Sketches(80)
    rng = random.Random(3)
    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(600)], np.uint64)
        a, b = (np.unique(pool[rng.sample(range(600), rng.randint(1, 600))]) for _ in range(2))
        near = int(sketches.apart(sketches.of(a), sketches.of(b)[None])[0])
        assert near <= len(np.setxor1d(a, b)) and (near == 0 or len(np.setxor1d(a, b)))
