"""Map similarity with facings against plain Python."""

import random

from scorewright.operators import spatial

NAMES = {"top": "up", "north": "up", "front": "inner", "west": "left"}
ORDER = ["up", "right", "down", "left"]


def sign(x):
    return (x > 0) - (x < 0)


def plain(pred, gold):
    shared = sorted(set(pred) & set(gold))
    best = (0.0, 0.0, 0.0, None)
    for k, (c, s) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)] if shared else []):
        marks, faces = [], []
        for i, a in enumerate(shared):
            for b in shared[i + 1 :]:
                dx, dy = pred[a][0] - pred[b][0], pred[a][1] - pred[b][1]
                tx, ty = c * dx - s * dy, s * dx + c * dy
                marks.append(((sign(tx) == sign(gold[a][0] - gold[b][0])) + (sign(ty) == sign(gold[a][1] - gold[b][1]))) / 2)
            face = [NAMES.get((f or "").strip().lower(), (f or "").strip().lower()) or None for f in (pred[a][2], gold[a][2])]
            if face[1]:
                turned = ORDER[(ORDER.index(face[0]) + k) % 4] if face[0] in ORDER else face[0]
                faces.append(turned == face[1])
        d, f = sum(marks) / len(marks) if marks else 0.0, sum(faces) / len(faces) if faces else 1.0
        if round(0.7 * d + 0.3 * f, 12) > round(best[2], 12) or best[3] is None:
            best = (d, f, 0.7 * d + 0.3 * f, 90 * k)
    return (*best, len(shared) / len(gold))


def test_map_similarity(spark):
    rng = random.Random(8)
    maps = []
    for k in range(60):
        side = lambda n: {f"o{j}": (float(rng.randint(0, 3)), float(rng.randint(0, 3)), rng.choice(["Top", "right", "down ", "west", "inner", "", None])) for j in rng.sample(range(6), n)}
        maps.append((side(rng.randint(0, 5)), side(rng.randint(1, 5))))
    turned = {"a": (0.0, 1.0, "up"), "b": (2.0, 5.0, "left"), "c": (-1.0, 0.0, None)}
    maps.append(({n: (y, -x, ORDER[(ORDER.index(f) + 3) % 4] if f else f) for n, (x, y, f) in turned.items()}, turned))
    table = lambda side: spark.createDataFrame([(k, n, *v) for k, m in enumerate(maps) for n, v in m[side].items()], "map_id long, name string, x double, y double, facing string")
    got = {r["map_id"]: r for r in spatial.map_similarity(table(0), table(1)).collect()}
    for k, (pred, gold) in enumerate(maps):
        r = got[k]
        assert [round(x, 9) if x is not None else None for x in (r["direction"], r["facing"], r["overall"], r["rotation"], r["coverage"])] == [round(x, 9) if x is not None else None for x in plain(pred, gold)], k
    last = got[len(maps) - 1]
    assert (last["direction"], last["facing"], last["rotation"]) == (1.0, 1.0, 90)
    bare = spatial.map_similarity(table(0).drop("facing"), table(1).drop("facing")).where("rotation is not null")
    assert {r["facing"] for r in bare.collect()} == {1.0}
