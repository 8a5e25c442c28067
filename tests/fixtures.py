"""Small graphs as edge lists."""


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(e.split("-")) for e in text.split()]


def _clique(names: str) -> str:
    parts = names.split()
    return " ".join(f"{a}-{b}" for i, a in enumerate(parts) for b in parts[i + 1 :])


GRAPHS = {
    "linear-chain": "A-B B-C C-D D-E",
    "social-hub": " ".join(f"alice-{x}" for x in "bob carol david emma frank grace henry iris jack kate".split())
    + " bob-carol carol-david david-bob emma-frank frank-grace grace-emma henry-iris iris-jack jack-henry carol-emma",
    "two-department": "alice-bob alice-carol alice-david bob-carol bob-david bob-emma carol-david carol-emma david-emma"
    " frank-grace frank-henry grace-henry grace-iris henry-iris iris-jack henry-jack carol-frank emma-frank carol-grace",
    "city-village": "nightclub-restaurant nightclub-cafe nightclub-gallery restaurant-cafe restaurant-museum cafe-gallery"
    " gallery-museum pub-farm farm-church church-school school-shop gallery-pub",
    "three-community": "alice-bob alice-carol alice-david bob-carol bob-david carol-david carol-emma david-emma "
    + _clique("frank grace henry iris")
    + " jack-kate jack-liam kate-liam liam-mia mia-noah kate-mia emma-liaison1 liaison1-frank iris-liaison2 liaison2-jack"
    " noah-liaison3 liaison3-alice",
    "quality-vs-popularity": "source-fame_connector fame_connector-target "
    + " ".join(f"fame_connector-hub_leaf{i}" for i in range(1, 5))
    + " source-specialist1 specialist1-specialist2 specialist2-target specialist1-sp1_peer1 specialist1-sp1_peer2"
    " sp1_peer1-sp1_peer2 sp1_peer1-specialist2 specialist2-sp2_peer1 specialist2-sp2_peer2 sp2_peer1-sp2_peer2"
    " sp2_peer1-target",
}
#: n, m, density, triangles, mean clustering, 2-core nodes, 3-core nodes, 3-truss edges, motif counts
GOLDENS = {
    "linear-chain": (5, 4, 0.4, 0, 0.0, 0, 0, 0, (1, 6, 3, 0)),
    "social-hub": (11, 20, 0.363636, 13, 0.777778, 10, 10, 19, (50, 63, 39, 13)),
    "two-department": (10, 19, 0.422222, 12, 0.696667, 10, 5, 19, (14, 72, 22, 12)),
    "city-village": (10, 12, 0.266667, 2, 0.183333, 5, 0, 5, (42, 62, 14, 2)),
    "three-community": (17, 26, 0.191176, 11, 0.480392, 17, 8, 19, (337, 307, 25, 11)),
    "quality-vs-popularity": (13, 17, 0.217949, 4, 0.330769, 9, 0, 10, (138, 113, 31, 4)),
}


def edges(name: str) -> list[tuple[str, str]]:
    return _path(GRAPHS[name])


def build(spark, name: str, directed: bool = False, types: dict | None = None):
    from graphloom.sources import PropertyGraph

    pairs = edges(name)
    ids = sorted({x for e in pairs for x in e})
    nodes = spark.createDataFrame([(i, (types or {}).get(i)) for i in ids], "id string, type string")
    return PropertyGraph.build(nodes, spark.createDataFrame(pairs, "src string, dst string"), directed)
