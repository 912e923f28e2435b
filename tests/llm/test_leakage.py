import random

from textloom.llm import leakage
from textloom.llm.leakage import Search, leaks, strip_form


def holds(text, form):
    need = -(-len(form) // 2)
    return need > 0 and any(form[i : i + need] in text for i in range(len(form) - need + 1))


def test_search_matches_brute_force():
    random.seed(11)
    forms = {"".join(random.choice("abc学") for _ in range(random.choice([1, 2, 5, 9, 20, 60]))): [i] for i in range(60)}
    tables = Search(forms)
    assert len(tables.tables) >= 3
    for _ in range(300):
        text = "".join(random.choice("abc学") for _ in range(random.randint(0, 120)))
        if random.random() < 0.6:
            form = random.choice(list(forms))
            a = random.randrange(len(form))
            text = text[:50] + form[a : a + random.randint(1, len(form))] + text[50:]
        assert tables.search(text) == {f for f in forms if holds(text, f)}


def test_leaks(spark, monkeypatch):
    passage = "Whenever Brako paints a wooden hut, exactly 712 owners gather by the school."
    half = strip_form(passage)[: -(-len(strip_form(passage)) // 2)]
    docs = [(1, f"xx {half.upper()} yy"), (2, half[:-1]), (3, "Ｗhenever, brаko paints a WOODEN hut exactly 712 owners gather"), (4, None), (5, ""), (6, "z" * 50_000 + half), (6, "z" * 50_000 + half)]
    items = [(10, passage), (11, passage), (12, None), (13, "…"), (14, ""), (10, passage), (15, "Quite another passage, on owners of paper houses by the sea in winter.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k", "2 as i")
    stated = spark.createDataFrame(items, "item_id long, text string")
    want = [(d, i) for d in (1, 3, 6) for i in (10, 11)]
    columns = dict(key="doc_id", text="text", item="item_id", passage="text")
    assert sorted(map(tuple, leaks(frame, stated, **columns).collect())) == want
    monkeypatch.setattr(leakage, "LETTERS", 1)
    assert sorted(map(tuple, leaks(frame, stated, **columns).collect())) == want
    assert leaks(frame.limit(0), stated, **columns).count() == 0 and leaks(frame, stated.limit(0), **columns).count() == 0
