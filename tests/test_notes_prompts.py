"""Notes, reading history, prompts and answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sitelake.operators import catalog, history, notes, ordering, prompts

RELS = [
    "alpha.md", "beta.md", "Fencing_grokipedia.md", "Canal-lock_wikipedia.md",
    "Canal-lock_grokipedia.md", "Science/Slate_grokipedia.md", "Old/Science/Slate_grokipedia.md",
    "Old/alpha.md", ".hidden/x.md", "figures/a.png", "___.md",
]


def index(spark, rels=RELS):
    return notes.note_index(spark.createDataFrame([("s", r) for r in rels], "site string, rel string"))


def test_index_and_canonical_copies(spark):
    found = index(spark)
    assert ".hidden/x.md" not in {r["rel"] for r in found.collect()}
    slugs = {r["slug"]: r["rel"] for r in notes.canonical_notes(found).collect()}
    assert slugs["canal-lock"] == "Canal-lock_grokipedia.md"
    assert slugs["slate"] == "Science/Slate_grokipedia.md"
    assert slugs["alpha"] == "alpha.md"
    labels = {r["rel"]: r["label"] for r in notes.note_labels(found).collect()}
    assert labels["alpha.md"] == "alpha.md" and labels["Old/alpha.md"] == "Old/alpha.md"
    assert labels["Science/Slate_grokipedia.md"] == "Science/Slate_grokipedia.md"
    assert labels["beta.md"] == "beta.md"


def test_search(spark):
    found = index(spark)
    assert sorted(r["rel"] for r in notes.name_search(found, " ALP ").collect()) == ["Old/alpha.md", "alpha.md"]
    assert notes.name_search(found, "a").count() == 0
    assert notes.name_search(found, "").count() == found.count()
    many = index(spark, [f"note {i:03}.md" for i in range(60)])
    hits = notes.name_search(many, "note").orderBy("pos").collect()
    assert len(hits) == 40 and hits[0]["rel"] == "note 000.md" and hits[0]["total"] == 60
    listed = notes.name_search(index(spark, [f"n{i}.md" for i in range(401)]), "").collect()
    assert len(listed) == 400 and {r["total"] for r in listed} == {401}
    assert notes.name_search(index(spark, [f"n{i}.md" for i in range(401)]), "", listed=None).count() == 401
    needles = spark.createDataFrame([(" Slate",), ("al",), ("a",), ("nothing",)], "needle string")
    assert {r["needle"]: r["total"] for r in notes.search_counts(found, needles).collect()} == {"slate": 2, "al": 4}
    first = notes.search_hits(found, needles, 1).collect()
    assert sorted((r["needle"], r["total"], r["pos"]) for r in first) == [("al", 4, 1), ("slate", 2, 1)]


def test_needles_of_any_length(spark):
    long = "ab" * 150
    found = index(spark, [f"x{long}y.md", "ab.md"])
    needles = spark.createDataFrame([(long,), ("ab",), (long + "z",)], "needle string")
    assert {r["needle"]: r["total"] for r in notes.search_counts(found, needles).collect()} == {long: 1, "ab": 2}


def test_folders(spark):
    files = spark.createDataFrame([("s", r) for r in RELS], "site string, rel string")
    assert sorted(r["folder"] for r in notes.top_folders(files).collect()) == ["Old", "Science", "figures"]
    listed = catalog.folder_pages(files, shown=3).filter("parent = ''").orderBy("is_dir", "pos", "name").collect()
    assert [(r["name"], r["more"]) for r in listed if not r["is_dir"]] == [
        ("Canal-lock_grokipedia.md", 3), ("Canal-lock_wikipedia.md", 3), ("Fencing_grokipedia.md", 3),
    ]
    assert [r["name"] for r in listed if r["is_dir"]] == ["Old", "Science", "figures"]


def test_links(spark):
    slugs = notes.canonical_notes(index(spark))
    cases = {
        "/page/Canal_lock#s": "/Canal-lock_grokipedia.md#s",
        "/page/Nope_nope#s": "/?q=nope-nope",
        "/page/": "/page/",
        "javascript:x": "#",
        "//evil": "#",
        "https://ok": "https://ok",
        "a/b.md": "a/b.md",
    }
    links = spark.createDataFrame([("s", d) for d in cases], "site string, dest string")
    assert {r["dest"]: r["url"] for r in notes.resolve_note_links(links, slugs).collect()} == cases


def test_routes(spark):
    files = spark.createDataFrame([("s", r) for r in RELS], "site string, rel string")
    cases = {
        "/": ("home", 200, None),
        "/?q=x": ("search", 200, None),
        "/?q=": ("home", 200, None),
        "/../secret": ("refused", 403, None),
        "/page/slate": ("note", 200, "Science/Slate_grokipedia.md"),
        "/page/none": ("absent", 404, None),
        "/science/": ("folder", 200, None),
        "/ALPHA.md": ("note", 200, "alpha.md"),
        "/figures/a.png": ("file", 200, "figures/a.png"),
        "/nope": ("absent", 404, None),
    }
    requests = spark.createDataFrame([("s", u) for u in cases], "site string, url string")
    found = notes.route_note_requests(requests, files).collect()
    assert {r["url"]: (r["answer"], r["status"], r["rel"]) for r in found} == cases


def test_natural_order(spark):
    names = ["10.html", "2.html", "index.html", "-a", "2", "02.html", "é", "99999999999.html"]
    rows = spark.createDataFrame([(1, n) for n in names], "g int, name string")
    found = ordering.ranked(rows, ["g"], ordering.natural_key(F.col("name"))).orderBy("rank").collect()
    assert [r["name"] for r in found] == ["-a", "02.html", "2", "2.html", "10.html", "99999999999.html", "index.html", "é"]


def test_ranks_over_uneven_groups(spark):
    rows = [("big", i * 7919 % 5000) for i in range(5000)] + [("small", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    found = ordering.ranked(df, ["g"], [F.col("v")])
    assert found.filter("rank <> v + 1").count() == 0 and found.count() == 5003


def test_batches(spark):
    picks = [(1, i, f"d{i % 10}") for i in range(30)] + [(2, 0, "x"), (2, 1, "x")]
    found = history.doc_batches(spark.createDataFrame(picks, "question_id int, pos int, rel string"))
    slots = {(r["question_id"], r["rel"]): r["slot"] for r in found.collect()}
    assert slots[(1, "d7")] == 8 and slots[(1, "d8")] is None and slots[(2, "x")] == 1 and len(slots) == 11
    found = history.batch_slots(spark.createDataFrame(picks, "question_id int, pos int, rel string"))
    asked = spark.createDataFrame([(1, "now"), (2, None), (3, "now"), (4, " ")], "question_id int, current string")
    sent = {(r["question_id"], r["rel"], r["error"]) for r in history.pages_to_send(asked, found).collect()}
    assert {(2, "x", None), (3, "now", None), (4, None, "no page")} <= sent
    assert sum(q == 1 for q, _, _ in sent) == 8


def test_replay(spark):
    log = [("add", f"d{i}") for i in range(8)] + [("add", "late"), ("remove", "d0"), ("add", "d3"), ("add", "d0"), ("remove", "zz")]
    rows = [("p", i, action, rel) for i, (action, rel) in enumerate(log)] + [("q", 0, "remove", "a")]
    found = history.replay_batches(spark.createDataFrame(rows, "pack string, seq int, action string, rel string"))
    assert [r["rel"] for r in found.orderBy("slot").collect()] == [f"d{i}" for i in range(1, 8)] + ["d0"]


def replayed(events, limit):
    """The batches of ``(pack, seq, action, rel)`` events, one by one."""
    batches = {}
    for pack, _, action, rel in sorted(events, key=lambda e: (str(e[0]), e[1:])):
        docs = batches.setdefault(pack, [])
        if action == "remove":
            batches[pack] = [d for d in docs if d != rel]
        elif rel not in docs and len(docs) < limit:
            docs.append(rel)
    return {(pack, i, rel) for pack, docs in batches.items() for i, rel in enumerate(docs, 1)}


@pytest.mark.parametrize("limit", [1, 3, 8])
@pytest.mark.parametrize("removals", [0.02, 0.5])
def test_replay_over_many_parts(spark, limit, removals):
    draw = random.Random(limit)
    packs = ["hot"] * 5 + ["b", "c", None]
    events = [
        (draw.choice(packs), i // 2, "remove" if draw.random() < removals else "add", f"d{draw.randrange(20)}") for i in range(4000)
    ]
    df = spark.createDataFrame(events, "pack string, seq int, action string, rel string").repartition(5)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        left = history.edits_that_count(df, limit).withColumn("part", F.spark_partition_id()).collect()
        found = {tuple(r) for r in history.replay_batches(df, limit).collect()}
    finally:
        spark.conf.set(setting, before)
    assert found == replayed(events, limit)
    assert len({r.part for r in left if r.pack == "hot"}) >= 3
    if removals < 0.1:
        assert len(left) < len(events) / 2


def test_span_forgets_without_harm():
    draw = random.Random(5)
    events = [("p", i, draw.choice(["add", "remove"]), f"d{draw.randrange(30)}") for i in range(3000)]
    span = history.Span(4, remembered=3)
    kept = [e for e in events if span.counts(*e[2:])]
    assert replayed(kept, 4) == replayed(events, 4) and len(kept) < len(events)


def test_replay_of_nothing(spark):
    none = spark.createDataFrame([], "pack bigint, seq int, action string, rel string")
    assert history.replay_batches(none).collect() == []


def test_current_page_and_newest_run(spark):
    visits = spark.createDataFrame(
        [("p", 1, 1, "a"), ("p", 2, 2, "b"), ("p", 3, 3, None), ("q", 1, 1, None)], "pack string, ts int, seq int, rel string"
    )
    assert [tuple(r) for r in history.current_page(visits).select("pack", "rel").collect()] == [("p", "b")]
    results = spark.createDataFrame([("k", 2, "new"), ("k", 1, "late old"), ("m", 1, "only")], "key string, gen int, v string")
    assert {r["v"] for r in history.latest_generation(results).collect()} == {"new", "only"}
    urls = spark.createDataFrame([("http://127.0.0.1:80/a",), ("http://127.0.0.1/a",), ("https://127.0.0.1:80/a",), ("http://x:80/",), ("nonsense",)], "u string")
    own = urls.select(F.coalesce(history.is_own_origin(F.col("u"), F.lit(80)), F.lit(False)))
    assert [r[0] for r in own.collect()] == [True, True, False, False, False]


def test_prompts(spark):
    docs = spark.createDataFrame(
        [("a.html", "<p>x</p><script>no</script>", True), ("b.md", "é" * 12003, False), ("c.md", "l\n" * 7000, False)],
        "rel string, text string, is_html boolean",
    )
    pages = spark.createDataFrame([(1, 1, "b.md"), (1, 2, "a.html"), (2, 1, "c.md")], "question_id int, slot int, rel string")
    asked = spark.createDataFrame([(1, "  "), (2, " Why? "), (3, "none")], "question_id int, question string")
    made = {r["question_id"]: r["prompt"] for r in prompts.build_prompts(asked, pages, docs).collect()}
    assert made[1] == (
        "Documents :\n\n## fichier: b.md\n\n" + "é" * 12000 + "\n[Document tronqué à 12 000 caractères.]\n"
        "\n## fichier: a.html\n\n<p>x</p>\n\nQuestion : Résume."
    )
    assert made[2] == "Documents :\n\n## fichier: c.md\n\n" + "l\n" * 6000 + "[Document tronqué à 12 000 caractères.]\n\nQuestion : Why?"
    assert 3 not in made
    body = prompts.chat_requests(prompts.build_prompts(asked, pages, docs), "m", "s").filter("question_id = 2").first()
    request = json.loads(body["request"])
    assert (request["model"], request["stream"], request["think"]) == ("m", True, False)
    assert [m["role"] for m in request["messages"]] == ["system", "user"] and request["messages"][1]["content"] == made[2]


CHAT = {
    1: ['{"message":{"content":"Ré"},"done":false}', "", '{"message":{"content":"ponse."},"done":true,"prompt_eval_count":321}'],
    2: ['{"message":{"content":"x"}}', '{"error":"model missing"}', '{"done":true}'],
    3: ['{"message":{"content":""},"done":true}'],
    4: ['{"message":{"content":"half"}}'],
    5: ['{"message":{"content":"x"},"done":true}', "{broken"],
    6: ['{"message":{"content":"one"},"done":true,"prompt_eval_count":0}'],
}
ANSWERS = {
    1: ("ok", "Réponse.", 321, None),
    2: ("error", None, None, "model missing"),
    3: ("empty", None, None, None),
    4: ("unfinished", None, None, None),
    5: ("unreadable", None, None, None),
    6: ("ok", "one", None, None),
}


def test_fold_chat(spark):
    lines = [(r, i, line) for r, body in CHAT.items() for i, line in enumerate(body)]
    chunks = prompts.parse_chunks(spark.createDataFrame(lines, "request_id long, ord long, line string").repartition(3))
    found = prompts.fold_chat(chunks).collect()
    assert {r["request_id"]: (r["status"], r["answer"], r["tokens"], r["error"]) for r in found} == ANSWERS


def test_long_answers_fold_in_order(spark):
    rows = spark.range(20000).selectExpr(
        "1L AS request_id", "id AS ord", "concat(id, ' ') AS content", "CAST(NULL AS BIGINT) AS tokens", "id = 19999 AS done", "CAST(NULL AS STRING) AS error"
    )
    found = prompts.fold_chat(rows.repartition(5)).first()
    assert found["answer"] == "".join(f"{i} " for i in range(20000))


def test_context_usage(spark):
    models = spark.createDataFrame([("m", 1000), ("n", None)], "model string, window int")
    runs = spark.createDataFrame(
        [(1, "m", 250, None), (2, "m", 250, 100), (3, "n", 5, None), (4, "m", None, None)],
        "run_id int, model string, used int, loaded_window int",
    )
    found = {r["run_id"]: (r["window"], r["percent"], r["full"]) for r in prompts.context_usage(runs, models).collect()}
    assert found == {1: (1000, 25.0, False), 2: (100, 100.0, True), 3: (None, None, False), 4: (1000, None, False)}
