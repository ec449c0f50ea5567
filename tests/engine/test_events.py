"""The feed of all events against a walk through them one by one, and the store that it writes."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lingoloom.sources import content_types as ct
from lingoloom.sources.deltas import Store
from lingoloom.streaming import events as ev
from lingoloom.streaming import feed, titles

SOURCE, TRASHED = "en-GB", -2
CONTEXT = {n: p["association_context"] for n, p in ct.TYPES.items()}
ITEMS = "content_type string, id long, language string, state int, title string"
QUEUE = "id long, content_type string, content_id long, do_not_translate int"
STATES = "id long, queue_id long, target_language string, translation_state string, source_version_id long"
LINKS = "id long, context string, key string"
EVENTS = "event_type string, content_type string, item_id long, version_id long, payload map<string,string>, ts timestamp, seq long"


def world(rnd):
    """Groups of items of all types, some queued, with cells; and events on them."""
    items, queue, states, links = [], [], [], []
    for kind in ct.TYPES:
        i = 0
        for g in range(14):
            for lang in rnd.sample([SOURCE, "fr-FR", "de-DE", "es-ES"], rnd.randint(1, 4)):
                i += 1
                items.append((kind, i, lang, 1, f"t{i % 3}"))
                if rnd.random() < 0.9:
                    links.append((i, CONTEXT[kind], f"k{g}"))
                if (lang == SOURCE and rnd.random() < 0.7) or rnd.random() < 0.1:
                    q = len(queue) + 1
                    queue.append((q, kind, i, 0))
                    states += [(100 * q + k, q, x, rnd.choice(["pending", "review", "approved", "published"]), rnd.randint(0, 9)) for k, x in enumerate(["fr-FR", "de-DE", "es-ES"]) if rnd.random() < 0.8]
        links.append((1000 + i, CONTEXT[kind], "k1"))  # a member that isn't there
    events = []
    for seq in range(400):
        kind, item = rnd.choice(items)[:2] if rnd.random() < 0.97 else ("unmanaged", 1)
        item = item if rnd.random() < 0.97 else 5000
        what = rnd.choice(["save", "save", "version", "state", "state", "delete", "seen"] if rnd.random() < 0.6 else ["save", "version", "state"])
        payload = {"save": lambda: rnd.choice([{}, {"title": f"t{rnd.randint(0, 2)}"}, {"flag": str(rnd.randint(0, 1))}, {"flag": "x", "title": "new"}, None]), "state": lambda: rnd.choice([{"value": "-2"}, {"value": str(rnd.randint(0, 1))}, None])}.get(what, dict)()
        events.append((what, kind, item, rnd.randint(1, 12) if what == "version" else None, payload, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=seq // 3), seq))
    return items, queue, states, links, events


def number(x):
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def walk(items, queue, states, links, events):
    """One event after another."""
    items = {(k, i): [lang, s, t] for k, i, lang, s, t in items}
    queue = {(k, c): [q, f] for q, k, c, f in queue}
    states = {(q, lang): [s, v] for _, q, lang, s, v in states}
    links = {(c, i): k for i, c, k in links}
    fresh = 10**6

    def group(kind, i):
        key = links.get((CONTEXT[kind], i))
        return [j for (c, j), k in links.items() if c == CONTEXT[kind] and k == key and (kind, j) in items and j != i] if key is not None else []

    def stale(kind, i, version):
        if row := queue.get((kind, i)):
            for (q, _), cell in states.items():
                if q == row[0] and cell[0] in ("review", "approved", "published") and (version is None or cell[1] < version):
                    cell[0] = "pending"

    def remove(kind, i):
        others = group(kind, i)
        row = queue.pop((kind, i), None)
        if row is None:
            if sources := [queue[kind, j][0] for j in others if (kind, j) in queue]:
                states.pop((min(sources), items[kind, i][0]), None)
        del items[kind, i]
        if kind in ct.self_associated() and (key := links.get((CONTEXT[kind], i))) is not None:
            mine = [x for x, k in links.items() if x[0] == CONTEXT[kind] and k == key]
            for x in mine if len(mine) <= 2 else [(CONTEXT[kind], i)]:
                del links[x]
        if row is not None:
            for cell in [c for c in states if c[0] == row[0]]:
                del states[cell]
            for j in others:
                if (kind, j) in items:
                    remove(kind, j)

    for what, kind, i, version, payload, _, _ in sorted(events, key=lambda e: e[5:]):
        if kind not in CONTEXT or (kind, i) not in items:
            continue
        payload = payload or {}
        if what == "save":
            if "title" in payload:
                if items[kind, i][2] != payload["title"] and kind not in ct.versioned():
                    stale(kind, i, None)
                items[kind, i][2] = payload["title"]
            if (flag := number(payload.get("flag"))) is not None and items[kind, i][0] == SOURCE:
                if (kind, i) in queue:
                    queue[kind, i][1] = flag
                elif flag == 1:
                    fresh += 1
                    queue[kind, i] = [fresh, 1]
        elif what == "version" and kind in ct.versioned():
            stale(kind, i, version)
        elif what == "state" and (value := number(payload.get("value"))) is not None:
            items[kind, i][1] = value
            if value == TRASHED and (kind, i) in queue:
                for j in group(kind, i):
                    items[kind, j][1] = value
        elif what == "delete":
            remove(kind, i)
    return {"items": {(*k, *v) for k, v in items.items()}, "queue": {(*k, v[1]) for k, v in queue.items()}, "states": {(*k, *v) for k, v in states.items()}, "associations": {(c, i, k) for (c, i), k in links.items()}}


def held(store):
    rows = lambda t, *cols: {tuple(r) for r in store.read(t).select(*cols).collect()}
    out = {"items": rows("items", "content_type", "id", "language", "state", "title"), "queue": rows("queue", "content_type", "content_id", "do_not_translate"), "states": rows("states", "queue_id", "target_language", "translation_state", "source_version_id"), "associations": rows("associations", "context", "id", "key")}
    ids = [r.id for r in store.read("queue").select("id").collect()]
    assert len(ids) == len(set(ids))
    return out


def store_of(spark, folder, world_, **more):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(world_, (ITEMS, QUEUE, STATES, LINKS), strict=True)]
    return Store(spark, folder, ev.kept(*frames), buckets=3, **more)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_batch_equals_the_walk(spark, tmp_path, seed):
    *world_, events = world(random.Random(seed))
    store = store_of(spark, str(tmp_path), world_)
    ev.at_once(spark.createDataFrame(events, EVENTS), store, SOURCE)
    want = walk(*world_, events)
    got = held(store)
    for table in want:
        assert got[table] == want[table], (table, got[table] ^ want[table])


class Killed(Exception):
    pass


def test_a_stream_cut_up_killed_and_repeated_equals_the_walk(spark, tmp_path, monkeypatch):
    *world_, events = world(random.Random(3))
    store = store_of(spark, f"{tmp_path}/store", world_, fold=2)
    for k in range(3):  # a file is a micro-batch
        part = spark.createDataFrame(events[k * 140 : (k + 1) * 140], EVENTS).coalesce(1)
        part.write.parquet(f"{tmp_path}/in/{k}")
    paths = sorted(f"{tmp_path}/in/{k}/{n}" for k in range(3) for n in os.listdir(f"{tmp_path}/in/{k}") if n.endswith(".parquet"))
    os.mkdir(f"{tmp_path}/feed")
    for k, p in enumerate(paths):
        os.rename(p, f"{tmp_path}/feed/{k}.parquet")
        os.utime(f"{tmp_path}/feed/{k}.parquet", (1000 + k, 1000 + k))
    go = lambda: ev.dispatching(feed.streamed(spark, f"{tmp_path}/feed", files=1), store, f"{tmp_path}/run", SOURCE).awaitTermination()
    real, done = Store._write, []

    def fails(self, record):
        done.append(record["commit"])
        if done == [1, 2]:  # the second batch's deltas are there, its record isn't
            raise Killed
        real(self, record)

    monkeypatch.setattr(Store, "_write", fails)
    with pytest.raises(Exception, match="Killed"):
        go()
    assert store.last("events") == 0
    go()
    assert done == [1, 2, 2, 3] and store.last("events") == 2
    assert held(store) == walk(*world_, events)
    ev.at_once(spark.createDataFrame(events, EVENTS), store, SOURCE, batch=1)  # an old batch again
    assert done == [1, 2, 2, 3]


def size(folder):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names)


def test_a_store_writes_what_changes_and_folds(spark, tmp_path):
    rows = spark.range(50_000).select("id", (F.col("id") % 7).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    store = Store(spark, str(tmp_path), {"t": (rows, ["id"], ["id"])}, buckets=8, fold=4)
    want = {i: i % 7 for i in range(50_000)}
    whole = size(f"{tmp_path}/t")
    rnd = random.Random(1)
    for n in range(6):
        ids = rnd.sample(range(60_000), 5)
        store.commit("w", n, {"t": (spark.createDataFrame([(i, n + 100, "s") for i in ids[:4]], "id long, x long, s string"), spark.createDataFrame([(ids[4],)], "id long"))})
        want |= dict.fromkeys(ids[:4], n + 100)
        want.pop(ids[4], None)
        if n == 2:
            assert size(f"{tmp_path}/t/delta") < whole / 100 and not os.path.exists(f"{tmp_path}/t/base/3")
    assert {r.id: r.x for r in store.read("t").collect()} == want
    near = spark.createDataFrame([(3,), (59_999,)], "id long")
    part = store.read("t", near)
    assert {r.x for r in part.where("id = 3").collect()} == {want[3]} and 0 < part.count() < 30_000
    # another store in the same folder goes on from there
    again = Store(spark, str(tmp_path), {"t": (rows.limit(1), ["id"], ["id"])}, buckets=8, fold=4)
    assert again.last("w") == 5 and again.commit("w", 5, {"t": (rows.limit(9), None)}) == 6 and again.read("t").count() == len(want)


def test_titles_as_state(spark, tmp_path):
    """A stream cut in order, with repeats, gives what one look at all saves gives."""
    rnd = random.Random(5)
    saves = [(rnd.choice([1, 1, 1, 2, 3, 4]), seq, rnd.choice(["a", "b", None] if seq % 50 == 0 else ["a", "b"])) for seq in range(300)]
    want, last = set(), {}
    for item, seq, title in saves:
        if last.get(item) is not None and title is not None and last[item] != title:
            want.add((item, seq, title, last[item]))
        last[item] = title
    cut = [saves[:120], saves[100:200], saves[200:] + saves[250:260]]
    for k, part in enumerate(cut):
        rnd.shuffle(part)
        spark.createDataFrame(part, "item_id long, seq long, title string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/{k}.parquet")
        os.utime(f"{tmp_path}/{k}.parquet", (1000 + k, 1000 + k))
    for idle in (None, 3_600_000):
        titles.write_changes(titles.title_stream(feed.streamed(spark, str(tmp_path), files=1), idle), f"{tmp_path}-{idle}").awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}-{idle}/changes/*").collect()]
        assert len(got) == len(set(got)) and set(got) == want
