"""Postal addresses that denote the same place.

An address is read into street, kind of street, house number, town and postcode; flats and
floors are set aside. Street and town are a vector of weighted character n-grams. Candidates come
from an inverted index over a prefix of each street's n-grams, the rarest ones, one more than the accepted
edits can change; its keys also have the house number and the place (town or postcode), so that
their number grows with the addresses of a town and not with those of the world. The cosine of the vectors
and the house number decide on a candidate; an exact check of edits, kinds of street and postcodes follows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.editjoin import distances, edit_join
from quern.llm.names import fold
from quern.operators.components import connected_components
from quern.session import cut_lineage, ship_package, shuffled

#: Letters of the shorter street from which two edits are accepted; one below.
TWO_EDITS_FROM = 7
#: 2-grams that one edit changes at most: a swap of neighbours lies in three.
GRAMS_PER_EDIT = 3
#: Streets up to this length can lose every 2-gram by one edit, or meet one that can.
SHORT_STREET = 3
#: Least cosine of the vectors of one place: two swaps in a street of seven letters leave so much if the town is
#: the same; other streets of the town mostly have less.
LEAST_COSINE = 0.33
#: Bounds of an n-gram's weight, the binary logarithm of how rare it is. What is rarer than one in 64
#: weighs as much, so that a slip, whose n-grams hardly anybody has, weighs alike in tables of all sizes.
LEAST_WEIGHT, MOST_WEIGHT = 3.0, 6.0
#: A repeated n-gram of a text is told apart up to this number; bounds the n-grams there are.
MOST_REPEATS = 9
#: Towns from this length are alike up to two edits; a town cut off has so many letters at least.
LONG_TOWN, CUT_TOWN = 5, 3

# Words for kinds of street, by the kind they mean.
STREET_KINDS = {
    word: kind
    for kind, words in {
        "street": "street st str", "road": "road rd", "lane": "lane ln la", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd bd boul bvd boulv",
        "drive": "drive dr drv", "crescent": "crescent cres cr crs cresc", "square": "square sq sqr", "gardens": "gardens gdns gdn garden gds", "court": "court ct",
        "rue": "rue r", "place": "place pl plc", "avenida": "avenida avda avd avenid", "calle": "calle c cl cll", "paseo": "paseo po p pso ps", "plaza": "plaza plza pza plz",
        "strasse": "strasse", "platz": "platz", "weg": "weg", "allee": "allee", "gasse": "gasse", "gatan": "gatan", "vagen": "vagen", "torget": "torget",
    }.items()
    for word in words.split()
}
# Kinds of street at the end of a compound, in full and shortened.
COMPOUND_KINDS = (
    ("strasse", "strasse"), ("strase", "strasse"), ("str", "strasse"), ("platz", "platz"), ("pl", "platz"), ("weg", "weg"), ("w", "weg"), ("allee", "allee"), ("all", "allee"), ("al", "allee"),
    ("gatan", "gatan"), ("gata", "gatan"), ("gat", "gatan"), ("g", "gatan"), ("vagen", "vagen"), ("vaegen", "vagen"), ("vag", "vagen"), ("v", "vagen"), ("torget", "torget"), ("torg", "torget"), ("t", "torget"),
)
# Parts of a building.
UNIT_WORDS = "flat|apartment|apt|appt|appartement|suite|ste|unit|room|rm|floor|fl|building|bldg|block|bat|batiment|esc|escalera|piso|puerta|pta|lgh|wohnung|whg|etage|stock|office|studio"
UNIT = re.compile(
    rf"\b(?:{UNIT_WORDS})\b\.?\s*[0-9]*\s*[a-z]?\b(?![a-z])"
    r"|\b\d+\s*(?:e|er|eme)\s+etage\b|\b\d+\s*\.?\s*(?:og|ug|tr|st|nd|rd|th)\b\.?(?:\s*floor)?|\b(?:og|eg|dg)\b"
    r"|\bbajo\b|\bhinterhaus\b|\bvorderhaus\b|\bground floor\b|\bnb\b"
)
POST_BOX = re.compile(r"\b(?:p\.?\s*o\.?\s*box|post\s*box|postfach|post office box|apartado|apdo|boite postale|b\.?\s?p\.?\s*\d|postbox|gpo box)\b|^\s*box\s*\d", re.I)
POSTCODE = re.compile(r"\b(?:s-?\s?\d{3}\s?\d{2}|[a-z]{1,2}\d{1,2}[a-z]?\s?\d[a-z]{2}|(?:[a-z]{1,2}-)?\d{5})\b")
HOUSE = re.compile(r"\b(\d{1,4})\s?([a-z])?\b")
SMALL_WORDS = frozenset("de la le les du des del der die das den el los las of the nr no num numero number n".split())
# Words of town names by their short form.
TOWN_WORDS = {
    "saint": "st", "sankt": "st", "sainte": "st", "san": "st", "santa": "st", "santo": "st", "ste": "st", "s": "st", "fort": "ft", "upper": "upr", "lower": "lwr", "north": "n", "south": "s_", "east": "e", "west": "w", "mount": "mt",
}


def read_town(town: str | None) -> str:
    """Town without quarter in small letters, with usual words shortened and as it is: ``storvin/saintorvin``."""
    if not town:
        return ""
    text = fold(town)
    text = re.sub(r"\([^()]*\)|,.*$|[- ](?:centre|center|zentrum|centro)\b", " ", text)
    words = [w for w in re.split(r"[^a-z]+", text) if w and w != "cedex"]
    short = "".join(TOWN_WORDS.get(w, w) for w in words)
    return f"{short}/{''.join(words)}" if words else ""


def read_address(address: str | None, city: str | None, postcode: str | None) -> tuple | None:
    """``(street, kind, number, town, postcode)``, or None where it can't denote a house."""
    if not address or address == "NULL" or POST_BOX.search(address):
        return None
    text = re.sub(r"\bn\.?\s?[º°]|№", " no ", address, flags=re.I)
    text = re.sub(r"\d+\s*[ºª°]\s*(?:[A-Za-z]\b)?", " ", text)  # floor and door
    text = fold(text)
    code = fold(postcode or "").replace(" ", "").replace("-", "").removeprefix("s") if postcode != "NULL" else ""
    town = "" if city == "NULL" else read_town(city)
    m = POSTCODE.search(text)
    if m and m.start() > 0:  # postcode and town at the end of the address
        code = code or m.group().replace(" ", "").replace("-", "").removeprefix("s")
        town = town or read_town(text[m.end() :].strip(" ,"))
        text = text[: m.start()]
    text = re.sub(r"\([^()]*\)", " ", text)
    text = UNIT.sub(" ", text)
    text = re.sub(r"\bc/\s*", "calle ", text)
    m = HOUSE.search(text)
    if not m:
        return None
    number = str(int(m.group(1))) + (m.group(2) or "")
    text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", text)
    written = re.findall(r"[a-z]+\.?", text)
    words = [(w.rstrip("."), w.endswith(".")) for w in written]
    words = [(w, s) for i, (w, s) in enumerate(words) if w not in SMALL_WORDS or len(words) == 1 or (w == "la" and (s or i == len(words) - 1))]
    kind, left = "", []
    for w, s in words:
        if w in STREET_KINDS and not kind and len(words) > 1:
            kind = STREET_KINDS[w]
        else:
            left.append((w, s))
    if not left:
        return None
    if not kind:
        last, stopped = left[-1]
        for tail, meant in sorted(COMPOUND_KINDS, key=lambda x: -len(x[0])):
            if last.endswith(tail) and len(last) - len(tail) >= 4 and (stopped or len(tail) >= 3):
                kind = meant
                left[-1] = (last[: -len(tail)], False)
                break
    street = "".join(w for w, _ in left)
    code = code.rjust(5, "0") if code.isdigit() else code
    return (street, kind, number, town, code) if len(street) >= 2 else None


def read_addresses(df: DataFrame) -> DataFrame:
    """``key`` with street, kind, number, town and postcode; unreadable ones are left out."""
    ship_package(df.sparkSession)
    schema = "key string, street string, kind string, number string, town string, code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, *x in zip(b["key"], b["address"], b["city"], b["postalCode"]):
                got = read_address(*x)
                if got:
                    rows.append((key, *got))
            yield pd.DataFrame(rows, columns=["key", "street", "kind", "number", "town", "code"])

    return df.select("key", "address", "city", "postalCode").mapInPandas(run, schema)


def grams(text: str) -> list[str]:
    """Character 2-grams of a street or town with marked ends, repeated ones numbered.

    Very short texts also have themselves and what is left without one letter,
    by which any two within one edit meet.
    """
    s = f"^{text}$"
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(s) - 1):
        g = s[i : i + 2]
        if seen[g] <= MOST_REPEATS:
            out.append(f"{g}{seen[g] or ''}")
        seen[g] += 1
    if len(text) <= SHORT_STREET:
        out += {f"-{text}", *(f"-{text[:i]}{text[i + 1:]}" for i in range(len(text)))}
    return out


def prefix(street: str, rarity: Mapping[str, float]) -> list[str]:
    """The rarest n-grams of a street, of which an accepted one has one in common, too.

    An edit changes GRAMS_PER_EDIT n-grams at most, so one more than the accepted
    edits can change are enough; very short streets keep all.
    """
    found = grams(street)
    if len(street) <= SHORT_STREET:
        return found
    edits = 2 if len(street) >= TWO_EDITS_FROM else 1
    return sorted(found, key=lambda g: (-rarity.get("s" + g, math.inf), g))[: edits * GRAMS_PER_EDIT + 1]


def _kinds_agree(a: str, b: str) -> bool:
    if a == b or not a or not b:
        return True
    # one-letter and shared abbreviations leave the kind open
    alike = [{"street", "strasse", "calle"}, {"place", "platz", "plaza"}, {"avenue", "avenida"}, {"rue", "road"}, {"gatan", "weg"}, {"paseo", "place"}]
    return any(a in s and b in s for s in alike)


def same_places(a: Mapping[str, Sequence[str]], b: Mapping[str, Sequence[str]]) -> np.ndarray:
    """The exact check of pairs of readings with one house number, all at once."""
    kinds = np.array([_kinds_agree(x, y) for x, y in zip(a["kind"], b["kind"])], bool)
    halves = [[t.split("/") if t else ("", "") for t in side["town"]] for side in (a, b)]
    (ta, fa), (tb, fb) = (([x[0] for x in h], [x[1] for x in h]) for h in halves)
    street, code = distances(a["street"], b["street"], 2), distances(a["code"], b["code"], 2)
    town = np.minimum(distances(ta, tb, 2), distances(fa, fb, 2))
    size = lambda texts: np.fromiter(map(len, texts), np.int64, len(texts))
    shorter, short_town = np.minimum(size(a["street"]), size(b["street"])), np.minimum(size(ta), size(tb))
    near_street = (street <= 1) | ((street == 2) & (shorter >= TWO_EDITS_FROM))
    has_codes, has_towns = (size(a["code"]) > 0) & (size(b["code"]) > 0), (size(ta) > 0) & (size(tb) > 0)
    one_code, other_code = has_codes & (code <= 1), has_codes & (code > 1)
    same_town = (town == 0) & ((street < 2) | ~other_code)
    begins = np.array([x.startswith(y) or y.startswith(x) for x, y in zip(ta, tb)], bool) & (short_town >= CUT_TOWN)
    near_town = (((town <= 2) & (short_town >= LONG_TOWN)) | begins) & ~other_code & (street + np.minimum(town, 1) <= 2)
    # no town on one side: the postcode decides
    exact_code = np.array([x == y for x, y in zip(a["code"], b["code"])], bool)
    by_code = one_code & (street < 2 + exact_code)
    return kinds & near_street & np.where(has_towns, np.where(town == 0, same_town, near_town), by_code)


def same_place(a: tuple, b: tuple) -> bool:
    """The exact check of two readings with the same house number."""
    fields = ("street", "kind", "number", "town", "code")
    return bool(same_places(*({f: [v] for f, v in zip(fields, x)} for x in (a, b)))[0])


def cosines(a: Mapping[str, Sequence[str]], b: Mapping[str, Sequence[str]], rarity: Mapping[str, float]) -> np.ndarray:
    """Cosines of the weighted n-grams of street and town; of street and postcode if either has no town."""
    cache: dict[tuple[str, str], tuple[dict[str, float], float]] = {}

    def vector(space: str, text: str) -> tuple[dict[str, float], float]:
        got = cache.get((space, text))
        if got is None:
            own = {space + g: min(max(rarity.get(space + g, MOST_WEIGHT), LEAST_WEIGHT), MOST_WEIGHT) ** 2 for g in grams(text)}
            got = cache[space, text] = (own, sum(own.values()))
        return got

    out = np.zeros(len(a["street"]))
    for row, (sa, sb, ta, tb, ca, cb) in enumerate(zip(a["street"], b["street"], a["town"], b["town"], a["code"], b["code"])):
        place = (vector("t", ta.split("/")[0]), vector("t", tb.split("/")[0])) if ta and tb else (vector("c", ca), vector("c", cb))
        parts = [(vector("s", sa), vector("s", sb)), place]
        shared = sum(w for (x, _), (y, _) in parts for g, w in x.items() if g in y)
        out[row] = shared / math.sqrt(sum(x[1] for x, _ in parts) * sum(y[1] for _, y in parts))
    return out


def gram_rarity(nodes: DataFrame) -> dict[str, float]:
    """Binary logarithm of one over the share of all readings that have an n-gram, for streets (s..) and towns (t..).

    All readings are counted. N-grams are two of the letters a to z and the marks of both ends, with a number up to
    MOST_REPEATS, or texts of up to three of these: so their number is bounded whatever the table.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter[str] = Counter()
            for street, town in zip(b["street"], b["town"]):
                seen.update({"s" + g for g in grams(street)})
                if town:
                    seen.update({"t" + g for g in grams(town.split("/")[0])})
            seen["all"] = len(b)
            yield pd.DataFrame({"gram": list(seen), "n": list(seen.values())})

    counts = {r["gram"]: r["n"] for r in nodes.select("street", "town").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop("all", 0)
    return {g: math.log2(total / n) for g, n in counts.items()}


def near_towns(towns: DataFrame, of: DataFrame) -> DataFrame:
    """``town``, ``near``: other towns that a town in ``of`` may stand for, by two edits or as one cut off.

    Both have distinct ``town`` (short and whole form, see ``read_town``); ``near`` is a short form.
    """
    short, whole = F.split("town", "/")[0], F.split("town", "/")[1]
    forms = lambda df: df.select("town", F.explode(F.array_distinct(F.array(short, whole))).alias("form"))
    all_forms, own_forms = forms(towns), forms(of)
    index = all_forms.select("form").distinct().select(F.xxhash64("form").alias("id"), F.col("form").alias("s"))
    probes = own_forms.select("form").distinct().select((F.xxhash64("form") + F.lit(1)).alias("probe_id"), F.col("form").alias("t"))
    met = edit_join(index, probes, 2).join(shuffled(index), "id").join(shuffled(probes), "probe_id").select(F.col("t").alias("form"), F.col("s").alias("other"))
    edited = own_forms.join(shuffled(met), "form").join(shuffled(all_forms.select(F.col("form").alias("other"), F.col("town").alias("other_town"))), "other")
    begins = lambda df: df.select("town", F.explode(F.expr(f"transform(sequence({CUT_TOWN}, greatest(length(split(town, '/')[0]), {CUT_TOWN})), n -> left(split(town, '/')[0], n))")).alias("begin"))
    cut = of.select("town", short.alias("begin")).join(shuffled(begins(towns).withColumnRenamed("town", "other_town")), "begin")
    longer = begins(of).join(shuffled(towns.select(F.col("town").alias("other_town"), short.alias("begin"))), "begin")
    both = edited.select("town", "other_town").unionByName(cut.select("town", "other_town")).unionByName(longer.select("town", "other_town"))
    return both.where(F.col("town") != F.col("other_town")).select("town", F.split("other_town", "/")[0].alias("near")).where(F.col("near") != short).distinct()


def candidates(nodes: DataFrame, rarity: Mapping[str, float]) -> DataFrame:
    """``id``, ``id_b`` (the larger) of readings with one house number that can be at one place.

    They share an n-gram of the street's prefix and a place: a form of the town, the
    postcode as it is or without one of its letters, or, for readings without a postcode, a
    town that theirs may stand for. ``same_places`` accepts no pair without.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places = []
            for town, code, near in zip(b["town"], b["code"], b["near"]):
                if near is not None:
                    places.append([f"t{near}"])
                    continue
                own = [f"t{x}" for x in dict.fromkeys(town.split("/"))] if town else []
                if code:
                    own += [f"c{x}" for x in dict.fromkeys([code, *(code[:i] + code[i + 1 :] for i in range(len(code)))])]
                places.append(own)
            yield pd.DataFrame({"id": b["id"], "number": b["number"], "size": b["street"].str.len(), "prefix": [prefix(x, rarity) for x in b["street"]], "places": places})

    own = nodes.select("id", "street", "number", "town", "code", F.lit(None).cast("string").alias("near"))
    codeless = nodes.where((F.col("code") == "") & (F.col("town") != ""))
    towns = cut_lineage(nodes.where(F.col("town") != "").select("town").distinct())
    more = codeless.join(shuffled(near_towns(towns, codeless.select("town").distinct())), "town").select("id", "street", "number", "town", "code", "near")
    spelled = own.unionByName(more).mapInPandas(run, "id long, number string, size long, prefix array<string>, places array<string>")
    keys = spelled.withColumn("place", F.explode("places")).withColumn("gram", F.explode("prefix")).select(F.xxhash64("number", "place", "gram").alias("key"), "id", "size")
    keys = cut_lineage(keys)
    other = keys.select("key", F.col("id").alias("id_b"), F.col("size").alias("size_b"))
    return keys.join(shuffled(other), "key").where((F.col("id") < F.col("id_b")) & (F.abs(F.col("size") - F.col("size_b")) <= 2)).select("id", "id_b").distinct()


def link_addresses(addresses: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """``key``, ``class_id``, ``links`` of every record whose address can be read.

    ``addresses`` has ``key``, ``address``, ``city`` and ``postalCode``. Records of
    one class denote the same place: same house number with its letter, vectors of street and town
    with a cosine of at least ``least_cosine``, and then streets within
    two edits, kinds of street that don't contradict, towns alike or, where one is
    missing, postcodes alike. Null addresses, post-office boxes and addresses
    without a house number are left out. Equal readings are one node, however many
    records have them; repeated rows count once. An empty table gives no rows.
    """
    read = cut_lineage(read_addresses(addresses.select("key", "address", "city", "postalCode").distinct()))
    fields = ["street", "kind", "number", "town", "code"]
    # a missing town is that of most records with the postcode
    both = read.where((F.col("town") != "") & (F.col("code") != "")).groupBy("code", "town").agg(F.count(F.lit(1)).alias("n"))
    usual = both.groupBy("code").agg(F.max_by("town", F.struct("n", "town")).alias("usual"))
    read = cut_lineage(
        read.join(shuffled(usual), "code", "left").withColumn("town", F.when(F.col("town") == "", F.coalesce("usual", F.lit(""))).otherwise(F.col("town"))).select("key", *fields)
    )
    nodes = cut_lineage(read.select(*fields).distinct().withColumn("id", F.xxhash64(*fields)))
    rarity = gram_rarity(nodes)
    named = [F.col(c).alias(f"{c}_b") for c in (*fields, "id")]
    met = candidates(nodes, rarity).join(shuffled(nodes), "id").join(shuffled(nodes.select(*named)), "id_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            a, b = ({f: p[f + end].tolist() for f in fields} for end in ("", "_b"))
            alike = cosines(a, b, rarity) >= least_cosine
            alike[alike] = same_places(*({f: [v for v, ok in zip(side[f], alike) if ok] for f in fields} for side in (a, b)))
            yield pd.DataFrame({"src": p["id"], "dst": p["id_b"]})[alike]

    links = cut_lineage(met.mapInPandas(verify, "src long, dst long"))
    classes = connected_components(links).withColumnRenamed("node", "id")
    degree = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    labelled = nodes.select("id").join(shuffled(classes), "id", "left").join(shuffled(degree), "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return read.withColumn("id", F.xxhash64(*fields)).select("key", "id").join(shuffled(labelled), "id").select("key", "class_id", "links").distinct()


def place_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different records of a class, the smaller key first."""
    a = members.select("class_id", F.col("key").alias("key_a"))
    b = members.select("class_id", F.col("key").alias("key_b"))
    return a.join(shuffled(b), "class_id").where(F.col("key_a") < F.col("key_b")).select("key_a", "key_b").distinct()
