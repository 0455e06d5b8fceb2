"""Archive and lookup operators against plain step-by-step models."""

import random

from sitelake.operators import archives, catalog

NAMES = ["a", "B", "b", ".git", "__MACOSX", "n.md", "N.MD", "index.html", "Index.HTML", "OUVRIR.html", "ouvrir.HTML", "index.htm", "x.png", ".md"]


def hidden(name):
    return name.startswith(".") or name == "__MACOSX"


def walk(members):
    """Open folders one by one until something decides the archive."""
    files = {m for m, is_dir in members if not is_dir}
    dirs = {m for m, is_dir in members if is_dir}
    for path in list(files | dirs):
        parts = path.split("/")
        dirs.update("/".join(parts[:i]) for i in range(1, len(parts)))
    root = ""
    for _ in range(64):
        start = f"{root}/" if root else ""
        below = [f[len(start):] for f in files if f.startswith(start)]
        here = [f for f in below if "/" not in f]
        for wanted, exact in (("ouvrir.html", "OUVRIR.html"), ("index.html", "index.html"), ("index.htm", "index.htm")):
            spellings = [f for f in here if f.lower() == wanted]
            if spellings:
                entry = exact if exact in spellings else wanted if wanted in spellings else min(spellings)
                return root, "site", entry
        notes = any(
            len(f.split("/")[-1]) > 3 and f.lower().endswith(".md") and not any(map(hidden, f.split("/"))) for f in below
        )
        folders = {d[len(start):] for d in dirs if d.startswith(start) and "/" not in d[len(start):]}
        folders = {d for d in folders if d and not hidden(d)}
        if any(not hidden(f) for f in here) or len(folders) != 1:
            return (root, "notes", None) if notes else (None, "none", None)
        root = start + folders.pop()
    return None, "none", None


def random_members(rng):
    members = {}
    for _ in range(rng.randint(1, 5)):
        wrapper = rng.choice([[], ["w"], ["w", "v"]])
        parts = wrapper + [rng.choice(NAMES) for _ in range(rng.randint(1, 2))]
        members["/".join(parts)] = rng.random() < 0.2
    # A name cannot be a file and a folder.
    for path in list(members):
        if any(other.startswith(path + "/") for other in members):
            members[path] = True
    return sorted(members.items())


def test_classification_follows_the_walk(spark):
    rng = random.Random(7)
    groups = {f"z{i}": random_members(rng) for i in range(600)}
    rows = [(archive, rel, is_dir) for archive, members in groups.items() for rel, is_dir in members]
    df = spark.createDataFrame(rows, "archive string, rel string, is_dir boolean")
    found = {r["archive"]: (r["root"], r["kind"], r["entry"]) for r in archives.classify_archives(df).collect()}
    for archive, members in groups.items():
        assert found[archive] == walk(members), members


def test_lookup_follows_a_dictionary(spark):
    rng = random.Random(3)
    letters = ["a", "A", "é", "É", "é", "/", "b"]
    words = lambda n: {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n)}
    files, asked = sorted(words(300)), sorted(words(600))

    import unicodedata

    def fold(name):
        return "".join(c.lower() if c.isascii() else c for c in unicodedata.normalize("NFC", name))

    chosen = {}
    for name in files:
        key = fold(name)
        best = chosen.get(key)
        if best is None or (name != key, name) < (best != key, best):
            chosen[key] = name
    stored = spark.createDataFrame([("s", f) for f in files], "site string, rel string")
    targets = spark.createDataFrame([("s", a) for a in asked], "site string, path string")
    found = {r["path"]: r["found"] for r in catalog.folded_lookup(targets, stored).collect()}
    for name in asked:
        assert found[name] == (name if name in files else chosen.get(fold(name))), name


def test_clashes_follow_the_order_of_writing(spark):
    rng = random.Random(5)
    groups = {f"s{i}": ["/".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(6)] for i in range(200)}
    rows = [(site, seq, rel) for site, rels in groups.items() for seq, rel in enumerate(rels)]
    kept = archives.drop_path_clashes(spark.createDataFrame(rows, "site string, seq int, rel string"))
    found = {}
    for r in kept.collect():
        found.setdefault(r["site"], set()).add(r["seq"])
    for site, rels in groups.items():
        written, want = set(), set()
        for seq, rel in enumerate(rels):
            parts = rel.split("/")
            above = {"/".join(parts[:i]) for i in range(1, len(parts))}
            if above & written or any(w.startswith(rel + "/") for w in written):
                continue
            written.add(rel)
            want.add(seq)
        assert found[site] == want, rels
