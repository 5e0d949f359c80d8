"""Spellings of the same person or organisation, linked.

Names are taken apart first: legal forms, words for trades, titles and additions
are set aside, the order is put right, nicknames are read as the names they stand
for. Which words name trades is learnt from the names themselves: they come after very
many different first words. What remains is compared by the segment join of ``editjoin``; names with
initials or cut-off words are then joined by their whole part. Links make classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.editjoin import distances, edit_join
from quern.operators.components import connected_components
from quern.session import cut_lineage, ship_package, shuffled

#: A word that follows this share of all first words names a trade if it mostly ends the name ...
TRADE_SHARE = 0.02
#: ... and one that follows this share if it mostly stands behind two other words.
LATE_SHARE = 0.005
#: Different first words that a trade must have at least, whatever the share.
LEAST_FIRSTS = 8
#: Names of more words than this are read as they stand: in their order, and nicknames as written. Others have
#: a reading for each word they may begin with, and for each name that a nickname may stand for.
MOST_WORDS = 8
#: Words up to this length with one letter changed are often other words (John, Joan).
SHORT_WORD = 5
#: ... unless one of the two is so many times as frequent as the other, which then is a slip.
SLIP_RATIO = 8

# Legal forms, without stops.
LEGAL = frozenset(
    "ltd limited inc incorporated llc lp llp plc co corp corporation company gmbh mbh gesellschaft ges ag kg ohg ab publ aktiebolag hb sarl sas sa sl slu srl spa bv nv oy as aps pty".split()
)
# General words for trades and kinds of firm, beside those learnt from the names.
TRADE_WORDS = (
    "agency airlines apparel architects associates auto automotive bakery bank beverages books brewery brewing brothers builders cars catering chemicals clothing coffee "
    "communications company construction consulting contractors dairy delicatessen design distribution education electric electronics energy engineering enterprises equipment "
    "exports farms fashion finance fisheries flowers foods foundation freight furniture garage goods group hardware health holdings hotel imports industries insurance "
    "international investments jewelry kitchen laboratories laundry logistics machinery management manufacturing market marketing materials media medical metals mining motors "
    "optics partners pharmacy plastics plumbing printing products properties provisions publishing realty recycling restaurant roofing security services shellfish shipping "
    "software solutions sons sports stores studios supplies supply systems technologies textiles tools tours toys traders trading transport travel wholesale wines"
).split()
# How an addition begins that repeats the name or names another.
ADDITION = re.compile(r"\s*[(,]?\s*\b(?:formerly|trading as|d/b/a|dba|t/a|a/k/a|aka|f/k/a|fka|c/o)\b.*$")
# Titles and suffixes of persons.
TITLES = frozenset("mr mrs ms miss mx dr prof sir dame rev hon frau herr fr hr sr sra srta don dona dna mme mlle monsieur madame m jr ii iii phd md".split())
# Names and their short and pet forms; those with a doubled last letter and y or ie follow by rule.
NAME_FORMS = """
abigail: abby; alexander: alex alec; alfred: alf; amanda: mandy; anastasia: nastya stacy; andrew: andy drew; anthony: tony; barbara: barb babs; bengt: benke; benjamin: ben;
brigitte: gitta birgit; charles: charlie chuck; christopher: chris topher; concepcion: concha conchita; cynthia: cindy; daniel: dan; david: dave; deborah: deb; dmitri: dima mitya;
dolores: lola loli dolly; donald: don; dorothy: dot dolly dory; edward: ed ned ted; ekaterina: katya kate; elizabeth: liz beth betty betsy eliza libby; francisco: paco pancho fran frank;
frederick: fred; friedrich: fritz fred; gabriel: gabe; gerald: gerry jerry; giuseppe: beppe peppe pino; gregory: greg; guadalupe: lupe lupita; gunilla: nilla; heinrich: heinz heiner;
henry: hank; ignacio: nacho; ivan: vanya; jacob: jake; james: jim jamie; jennifer: jen; johannes: hannes hans; jonathan: jon johnny; jose: pepe; joseph: joe joey; joshua: josh;
katherine: kate kat kath; kenneth: ken; kristoffer: kris stoffe; lawrence: larry; lennart: lelle; leonard: len leo; luigi: gigi gino; margaret: maggie peggy meg marge; matthew: matt;
michael: mike mick mickey; mikhail: misha; nicholas: nick; oksana: oksanka; pamela: pam; patricia: pat patty trish tricia; patrick: pat paddy; peter: pete; philip: phil; pilar: pili;
raymond: ray; rebecca: becky becca; richard: rick rich dick; robert: rob bob bert; ronald: ron; rosalind: rosie roz; samuel: sam; sebastian: basti bastian seb; sigrid: siri; steven: steve;
susan: sue susie suzy; svetlana: sveta lana; tadeo: tadek; theodore: ted theo; thomas: tom; timothy: tim; victoria: vicky tori; vincent: vince; vladimir: vova volodya vlad; walter: walt;
wilhelm: willi will; william: will bill; yevgeny: zhenya; zachary: zach zack
"""


def nickname_table(forms: str) -> dict[str, list[str]]:
    """Short forms and the names that each may stand for, of lines such as ``thomas: tom; ...``.

    A short form that ends with a consonant also comes with y or ie, its last letter
    doubled or not, unless that is a form of its own.
    """
    names: dict[str, list[str]] = defaultdict(list)
    for entry in forms.replace("\n", " ").split(";"):
        name, _, shorts = entry.partition(":")
        for short in shorts.split():
            names[short].append(name.strip())
    pet: dict[str, list[str]] = defaultdict(list)
    for short, of in names.items():
        if short[-1] not in "aeiouy":
            for stem in {short, short + short[-1]}:
                for tail in ("y", "ie"):
                    if stem + tail not in names:
                        pet[stem + tail] += [x for x in of if x not in pet[stem + tail]]
    return {**pet, **names}


NICKNAMES = nickname_table(NAME_FORMS)


def fold(text: str) -> str:
    """Small letters without accents."""
    text = text.casefold().replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _is_subsequence(short: str, word: str) -> bool:
    at = iter(word)
    return all(c in at for c in short)


def _near(a: str, b: str) -> bool:
    """Whether one edit, a swap of neighbours included, or none makes ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[at:], b[at:]
    if len(x) == len(y):
        return x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])
    return x[1:] == y if len(x) > len(y) else x == y[1:]


def shortens(token: str, word: str, stopped: bool = False, late: bool = True) -> bool:
    """Whether ``token`` is a customary abbreviation of ``word``: its beginning, its consonants, or its beginning and end.

    A mere beginning needs a stop or a ``late`` place in the name.
    """
    if len(token) < 3 or len(token) >= len(word) or token[0] != word[0]:
        return False
    if word.startswith(token):
        return stopped or late
    if not _is_subsequence(token, word):
        return False
    if len(token) <= len(word) - 2 and (not set(token[1:-1]) & set("aeiou") or (token[-1] == word[-1] and (late or len(token) <= len(word) // 2))):
        return True
    return len(word) >= 8 and len(token) >= 5 and token[:3] == word[:3]


def _one_stem(a: str, b: str, late: bool) -> bool:
    """Whether two words are forms of one: bakery and bakeries, import and imports; early in the name only if no doubt is left."""
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if not late and common < 6 and a + "s" != b and b + "s" != a:
        return False
    return common >= max(4, min(len(a), len(b)) - 2) and abs(len(a) - len(b)) <= 3


class Trades:
    """The words that name trades, and questions about them."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self._near: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            self._near[w[0]].append(w)
        self._asked: dict[tuple, bool] = {}

    def __reduce__(self):
        return Trades, (self.words,)

    def is_trade(self, token: str, stopped: bool, late: bool) -> bool:
        """Whether a word names a trade, in full, misspelt by one edit, or abbreviated."""
        if token in self.words:
            return True
        asked = (token, stopped, late)
        if asked not in self._asked:
            self._asked[asked] = self._is_trade(token, stopped, late)
        return self._asked[asked]

    def _is_trade(self, token: str, stopped: bool, late: bool) -> bool:
        if len(token) < 3:
            return False
        for w in self._near[token[0]]:
            if len(token) >= 6 and len(w) >= 6 and w[:2] == token[:2] and _near(token, w):
                return True
            if shortens(token, w, stopped, late) or _one_stem(token, w, late):
                return True
        return False

    def known(self, trades: Iterable[str]) -> str:
        """The words of those trades that are named in full."""
        return " ".join(sorted({w for t in trades if self.words.issuperset(t.split()) for w in t.split()}))

    def differ(self, a: str, b: str) -> bool:
        """Whether both name their trades in full and have none in common."""
        x, y = a.split(), b.split()
        if not x or not y or not self.words.issuperset(x + y):
            return False
        return not {w[:4] for w in x} & {w[:4] for w in y}

    def may_be(self, trade: str, known: str) -> bool:
        """Whether a trade that isn't named in full can be a known one; without a word it can be any."""
        short = [w.replace("'", "") for w in trade.split() if w not in self.words]
        return not short or any(w[0] == x[0] and (_is_subsequence(x, w) or _near(x, w) or _one_stem(x, w, True)) for x in short if x for w in known.split())

    def groups(self, trades: list[str]) -> list[str]:
        """A label for each of the trades of firms with equal words: firms with different labels are not one node.

        Known trades that differ get different labels, a trade that isn't named in full
        that of the only one it can be, and otherwise one of its own.
        """
        groups: list[set[str]] = []
        for t in sorted(t for t in trades if self.known([t])):
            met = [g for g in groups if any(not self.differ(t, x) for x in g)]
            groups = [g for g in groups if g not in met] + [{t}.union(*met)]
        if len(groups) < 2:
            return [""] * len(trades)
        labels = []
        for t in trades:
            fit = [g for g in groups if (t in g if self.known([t]) else self.may_be(t, self.known(g)))]
            labels.append(min(fit[0]) if len(fit) == 1 else "?")
        return labels

    def unfit(self, trades: list[str], met: list[tuple[int, str]]) -> list[str]:
        """Of known trades met at distances by a firm of unknown trade, those of firms it can't be.

        Those count that its shortened trade can be, if there are any, then the closest;
        if these differ, it is none of them.
        """
        tiers = [(not all(self.may_be(t, known) for t in trades), d) for d, known in met]
        best = [known for tier, (_, known) in zip(tiers, met) if tier == min(tiers)]
        if any(self.differ(x, y) for x in best for y in best):
            return sorted({known for _, known in met})
        return sorted({known for _, known in met if any(self.differ(known, x) for x in best)})


def company_words(name: str) -> list[str]:
    """Words of a firm's name as written, in small letters, without its legal form and additions."""
    text = re.sub(r"(?<=[^\W\d_A-Z]{4})(?=[A-Z][a-z.'’])", " ", name)  # words run together
    text = fold(text).replace("’", "'").replace("`", "'")
    text = ADDITION.sub("", text)
    text = re.sub(r"\(.*?\)?(?=\s|$)", " ", text) if "(" in text else text
    raw = [t for t in re.split(r"[\s,;:()]+", text) if t]
    if raw and raw[0] == "the" and len(raw) > 1:
        raw = raw[1:]
    # legal forms stand at the end, maybe with stops or blanks between their letters
    while len(raw) > 1:
        last = raw[-1].replace(".", "")
        if last in LEGAL and not (len(last) == 2 and "." in raw[-1] and last not in ("sa", "sl", "ab", "ag", "co")):
            raw.pop()
        elif len(last) == 1 and len(raw) > 2 and len(raw[-2].replace(".", "")) == 1 and (raw[-2] + raw[-1]).replace(".", "") in LEGAL:
            raw = raw[:-2]
        else:
            break
    return raw


def learn_trades(names: DataFrame, share: float = TRADE_SHARE, late_share: float = LATE_SHARE, least: int = LEAST_FIRSTS) -> list[str]:
    """Words that name trades, by how many different first words they follow.

    ``names`` has distinct ``name`` values of firms; all are counted. A firm with very many spellings has
    few first words, so that its own words don't count as trades. A word that follows more than ``share`` of all first words is
    one if it ends most of its names, and one that follows ``late_share`` if it stands behind two others in most of them; so there
    are fewer than the words of a name, on average, over ``late_share``, which bounds what the driver gets.
    """
    ship_package(names.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                words = [w.strip(".-&'") for w in company_words(name)]
                rows += [(w, words[0], int(at > 1), int(at == len(words) - 1)) for at, w in enumerate(words) if at and len(w) >= 4 and w.isalpha() and w not in LEGAL]
            yield pd.DataFrame(rows, columns=["word", "first", "late", "ends"])

    found = names.select("name").mapInPandas(run, "word string, first string, late long, ends long")
    words = cut_lineage(found.groupBy("word", "first").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"), F.sum("ends").alias("ends")))
    firsts = words.select("first").distinct().count()
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("firsts"), (F.sum("late") / F.sum("n")).alias("late"), (F.sum("ends") / F.sum("n")).alias("ends"))
    enough = ((F.col("firsts") > share * firsts) & (F.col("ends") > 0.5)) | ((F.col("firsts") > late_share * firsts) & (F.col("late") > 0.5))
    return sorted(r["word"] for r in counted.where(enough & (F.col("firsts") >= least)).collect())


def read_company(name: str, trades: Trades) -> dict | None:
    """``core`` words, their probe ``forms``, and for a shortened name ``whole`` and ``short``."""
    raw = company_words(name)
    turned = re.match(r"\s*[^\s,]+,", name) is not None  # what stands before a comma was at the end
    tokens = [(t.strip(".-&'").replace("-", ""), t.endswith(".")) for t in raw]
    kept: list[tuple[str, str, bool]] = []
    trade: list[str] = []
    halves: list[str] = []  # a trade word after the second kept word may be the rest of it
    i = 0
    while i < len(tokens):
        word, stopped = tokens[i]
        pair = word + tokens[i + 1][0] if i + 1 < len(tokens) else ""
        if pair in trades.words and len(pair) > 6:
            trade.append(pair)
            i += 2
            continue
        if word and (trades.is_trade(word.replace("'", ""), stopped, i > 1 or (turned and i == 0)) or word in LEGAL):
            if len(kept) == 2 and not trade and word in trades.words:
                halves.append(word)
            trade.append(word)
        elif word:
            kept.append((word, raw[i], stopped))
        i += 1
    if not kept:
        kept = [(w, r, s) for (w, s), r in zip(tokens, raw) if w]
        trade = []
    if not kept:
        return None
    # a shortened word: initials, a letter and an apostrophe, or cut off by a stop
    short = whole = None
    if len(kept) == 2:
        for k in (1, 0):
            word, written, stopped = kept[k]
            letters = word.replace(".", "")
            if re.fullmatch(r"[a-z](?:\.[a-z])+", word):
                short = f"{letters[0]}|{letters[-1]}|i"
            elif re.fullmatch(r"[a-z]'[a-z]{2,}", word):
                short = f"{word[0]}|{word[2:]}|a"
            elif stopped and len(letters) >= 3:
                short = f"{letters}||c"
            else:
                continue
            whole = kept[1 - k][0].replace("'", "").replace(".", "")
            break
    elif len(kept) > 2 and kept[-1][2] and len(kept[-1][0].replace(".", "")) >= 3:  # a word that no list knows, cut off by a stop
        whole, short = re.sub(r"[^a-z0-9]", "", "".join(w for w, _, _ in kept[:-1])), f"{kept[-1][0].replace('.', '')}||c"
    words = [re.sub(r"[^a-z0-9]", "", w) for w, _, _ in kept]
    words = [w for w in words if w]
    if not words:
        words = ["".join(c for c in w if c.isalnum()) for w, _, _ in kept]
        words = [w for w in words if w]
    if not words:
        return None
    forms = {"".join(words[i:] + words[:i]) for i in range(len(words) if len(words) <= MOST_WORDS else 1)}
    first = "".join(words)
    if halves:
        forms |= {first + halves[0], words[1] + halves[0] + words[0]}
    return {"core": first, "forms": sorted(forms), "parts": words, "trade": " ".join(sorted(set(trade))), "whole": whole, "short": short}


def read_contact(name: str, nicknames: Mapping[str, list[str]] = NICKNAMES) -> dict | None:
    """As ``read_company``; the parts are given name and family name."""
    text = fold(name).replace("’", "'")
    swapped = "," in text
    halves = [h for h in text.split(",")]
    if swapped and len(halves) >= 2:
        text = " ".join(halves[1:]) + " " + halves[0]
    raw = [t for t in re.split(r"[\s]+", text) if t]
    tokens = [(t.strip(".'-").replace("-", "").replace("'", ""), t.endswith(".")) for t in raw]
    tokens = [(w, s) for w, s in tokens if w]
    left = [(w, s) for w, s in tokens if w not in TITLES or (len(w) == 1 and s and w != "m")]
    if tokens and len(left) < 2 <= len(tokens):  # M. may be an initial
        left = tokens[-2:] if tokens[0][0] != "m" or len(tokens) == 2 else left
    if len(left) > 2:  # initials between or after
        middle = [x for k, x in enumerate(left) if len(x[0]) > 1 or k == 0]
        left = middle if len(middle) >= 2 else left
    if not left:
        return None
    words = [w for w, _ in left]
    short = whole = None
    if len(words) == 2:
        for k in (0, 1):
            # a stop cuts a name off, unless it stands behind a short form that isn't its beginning
            stands_for = nicknames.get(words[k], [words[k]])
            if len(words[k]) == 1 or (left[k][1] and len(words[k]) <= 4 and any(x.startswith(words[k]) for x in stands_for)):
                short, whole = f"{words[k]}||c", words[1 - k]
                break
            if len(stands_for) > 1:  # it depends on who else is there
                short, whole = f"{'/'.join(sorted(stands_for))}||n", words[1 - k]
                break
    options = [nicknames.get(w, [w]) if len(words) <= MOST_WORDS else [w] for w in words]
    forms = set()
    core = " ".join(words) if short and short.endswith("n") else None  # not that of one of the names it may stand for
    for choice in _choices(options):
        if len(words) == 2:
            forms |= {choice[0] + " " + choice[1], choice[1] + " " + choice[0]}
        else:
            forms.add(" ".join(choice))
        core = core or " ".join(choice)
    return {"core": core, "forms": sorted(forms), "parts": core.split(" "), "trade": "", "whole": whole, "short": short}


def _choices(options: list[list[str]]) -> list[list[str]]:
    """All readings; each name that may stand for two doubles them."""
    out: list[list[str]] = [[]]
    for o in options:
        out = [x + [y] for x in out for y in o]
    return out


def parse_names(df: DataFrame, trades: Trades, nicknames: Mapping[str, list[str]] = NICKNAMES) -> DataFrame:
    """Rows ``name_kind``, ``name`` with their reading; names without a letter are left out."""
    ship_package(df.sparkSession)
    schema = "name_kind string, name string, core string, forms array<string>, parts array<string>, trade string, whole string, short string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, name in zip(batch["name_kind"], batch["name"]):
                got = read_company(name, trades) if kind == "company" else read_contact(name, nicknames)
                if got:
                    rows.append((kind, name, got["core"], got["forms"], got["parts"], got["trade"], got["whole"], got["short"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select("name_kind", "name").mapInPandas(run, schema)


def fit(short: str, word: str) -> int | None:
    """How well ``word`` can be what ``short`` (see ``read_company``) shortens: 0 as it stands, 1 with one letter amiss, None not at all."""
    a, b, kind = short.split("|")
    if kind == "n":
        names = a.split("/")
        return 0 if word in names else 1 if any(len(x) > SHORT_WORD and _near(word, x) for x in names) else None
    if kind == "c":
        near = len(a) >= 4 and any(_near(a, word[:n]) for n in (len(a) - 1, len(a), len(a) + 1) if n <= len(word))
        return 0 if word.startswith(a) else 1 if near else None
    if not word.startswith(a):
        return None
    if kind == "i":
        return 0 if b in word[2:-2] else None
    if word.endswith(b):
        return 0
    return 1 if any(_near(b, word[-n:]) for n in (len(b) - 1, len(b), len(b) + 1) if 2 <= n < len(word)) else None


def _without_half(known: str, form: str, core: str) -> str:
    """Known trades less the word that a probe form (see ``halves`` of ``read_company``) takes as part of the name."""
    extra = len(form) - len(core)
    return " ".join(w for w in known.split() if not (extra and len(w) == extra and w in form))


def accepted(kind: list[str], a_parts: list, b_parts: list, one_trade: np.ndarray, distance: np.ndarray, a_counts: list, b_counts: list) -> np.ndarray:
    """The exact check of pairs from the segment join, all at once.

    Firms: one edit, or one edit in each of two words, or two edits where a trade is the
    same. Persons: one edit in each of given and family name, but no edit in a word of up to
    SHORT_WORD letters, unless one of the two is SLIP_RATIO times as frequent as the other.
    """
    company = np.array([k == "company" for k in kind], bool)
    ok = company & ((distance <= 1) | ((distance <= 2) & one_trade & np.array([len(a) != 2 or len(b) != 2 for a, b in zip(a_parts, b_parts)], bool)))
    ok |= ~company & (distance <= 1) & np.array([len(a) != 2 or len(b) != 2 for a, b in zip(a_parts, b_parts)], bool)
    two = np.flatnonzero(np.array([len(a) == 2 and len(b) == 2 for a, b in zip(a_parts, b_parts)], bool) & ~ok)
    if not len(two):
        return ok
    a = [[a_parts[i][0] for i in two], [a_parts[i][1] for i in two]]
    for turned in (0, 1):
        b = [[b_parts[i][turned] for i in two], [b_parts[i][1 - turned] for i in two]]
        d = np.stack([distances(x, y, 2) for x, y in zip(a, b)])
        each = (d <= 1).all(axis=0)
        firm = each | ((d.sum(axis=0) <= 2) & one_trade[two])
        person = each.copy()
        for row in np.flatnonzero(each & ~company[two]):
            for w in (0, 1):
                x, y = a[w][row], b[w][row]
                if d[w][row] and min(len(x), len(y)) <= SHORT_WORD:
                    n, m = a_counts[two[row]].get(x, 1), b_counts[two[row]].get(y, 1)
                    person[row] &= min(len(x), len(y)) >= 3 and max(n, m) >= SLIP_RATIO * min(n, m)
        ok[two] |= np.where(company[two], firm, person)
    return ok


def link_names(names: DataFrame, k: int = 2, trade_words: Iterable[str] = TRADE_WORDS, nicknames: Mapping[str, list[str]] = NICKNAMES) -> DataFrame:
    """``name_kind``, ``name``, ``class_id``, ``links`` for each distinct spelling.

    ``names`` has ``name_kind`` (``company`` or ``contact``) and ``name``. Spellings
    of one class name the same entity: their words are alike up to one edit a word
    (two edits where the trade is the same), in any order, nicknames taken as the
    names they stand for; see ``accepted`` for short words. A nickname that may stand for two names counts as a shortened one. Firms whose trades are known and differ are not linked; one
    of unknown trade joins those it fits best, and none of them if these differ. A spelling with an initial or a cut-off word joins the class
    that its whole word leads to, if there is exactly one such class; else it stays apart, together with equally
    shortened ones. Names of more than MOST_WORDS words are compared as they stand. Null and blank names are left out, repeated rows count once, other columns are not read.

    Words for trades are learnt from the names (``learn_trades``); ``trade_words`` are
    added to them. ``nicknames`` has the names that a short form may stand for. ``k`` bounds the
    edits of candidates, swaps of neighbours counted as one.
    """
    given = cut_lineage(names.where(F.col("name").isNotNull()).select("name_kind", "name").distinct())
    trades = Trades([*trade_words, *learn_trades(given.where(F.col("name_kind") == "company"))])
    spelled = cut_lineage(parse_names(given, trades, nicknames))
    by_core = spelled.groupBy("name_kind", "core").agg(F.collect_set("trade").alias("trades"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(kind, core, t, g) for kind, core, found in zip(b.name_kind, b.core, b.trades) for t, g in zip(found, trades.groups(list(found)))]
            yield pd.DataFrame(rows, columns=["name_kind", "core", "trade", "trade_group"])

    labels = by_core.mapInPandas(label, "name_kind string, core string, trade string, trade_group string")
    spelled = cut_lineage(spelled.join(shuffled(labels), ["name_kind", "core", "trade"]))
    # one node per reading: spellings that differ in case, accents, legal form or in how they put a trade only are one already
    nodes = cut_lineage(
        spelled.groupBy("name_kind", "core", "trade_group")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("forms"))).alias("forms"),
            F.min_by("parts", F.struct(F.abs(F.size("parts") - 2), F.col("parts"))).alias("parts"),
            F.sort_array(F.collect_set("trade")).alias("trades"),
            # a shortened name only if no spelling of it is full
            F.when(F.count("short") == F.count(F.lit(1)), F.min(F.struct("whole", "short"))).alias("cut"),
        )
        .select("name_kind", "core", "trade_group", "forms", "parts", "trades", "cut.whole", "cut.short", F.xxhash64("name_kind", "core", "trade_group").alias("id"))
    )
    # both kinds go through one join, told apart by their first character
    mark = F.when(F.col("name_kind") == "company", "#").otherwise("@")
    # how often the short words of persons come
    words = nodes.where((F.col("name_kind") == "contact") & F.col("short").isNull()).select("id", F.explode(F.array_distinct("parts")).alias("w")).where(F.length("w") <= SHORT_WORD + 1)
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = words.join(shuffled(often), "w").groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("word_counts"))
    full = cut_lineage(nodes.where(F.col("short").isNull()).join(shuffled(counts), "id", "left"))
    probes = full.select(F.col("id").alias("probe_id"), "name_kind", "core", F.explode("forms").alias("t"))
    same = full.join(shuffled(probes.select("probe_id", "name_kind", F.col("t").alias("core"))), ["name_kind", "core"]).where(F.col("id") != F.col("probe_id"))
    # names as they stand meet each other from the longer side; other orders and readings look both ways
    sought = probes.select("probe_id", F.concat(mark, "t").alias("t"), (F.col("t") != F.col("core")).alias("longer"))
    near = edit_join(full.select("id", F.concat(mark, "core").alias("s")), sought, k)
    a = full.select("id", "name_kind", F.col("parts").alias("a_parts"), F.col("trades").alias("a_trades"), F.col("word_counts").alias("a_counts"))
    b = full.select(F.col("id").alias("probe_id"), F.col("name_kind").alias("b_kind"), F.col("core").alias("b_core"), F.col("parts").alias("b_parts"), F.col("trades").alias("b_trades"), F.col("word_counts").alias("b_counts"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            equal = p.form.notna().to_numpy()  # the words are those of a probe
            x = [trades.known(t) for t in p.a_trades]
            y = [_without_half(trades.known(t), f, c) if e else trades.known(t) for e, t, f, c in zip(equal, p.b_trades, p.form, p.b_core)]
            one_trade = np.array([bool((set(t) & set(u)) - {""}) for t, u in zip(p.a_trades, p.b_trades)], bool)
            as_map = lambda c: [{r["w"]: r["n"] for r in v} if v is not None else {} for v in c]
            ok = accepted(p.name_kind.tolist(), p.a_parts.tolist(), p.b_parts.tolist(), one_trade, p.distance.to_numpy(), as_map(p.a_counts), as_map(p.b_counts))
            ok = (equal | ok) & np.array([not trades.differ(m, n) for m, n in zip(x, y)], bool)
            out = {"id": p.id, "probe_id": p.probe_id, "distance": p.distance, "a_trades": p.a_trades, "b_trades": p.b_trades, "a_known": x, "b_known": y}
            yield pd.DataFrame(out)[ok]

    met = near.withColumn("form", F.lit(None).cast("string")).unionByName(same.select("id", "probe_id", F.lit(0).alias("distance"), F.col("core").alias("form")))
    alike = cut_lineage(
        met.join(shuffled(a), "id")
        .join(shuffled(b), "probe_id")
        .where(F.col("name_kind") == F.col("b_kind"))
        .mapInPandas(check, "id long, probe_id long, distance int, a_trades array<string>, b_trades array<string>, a_known string, b_known string")
    )

    def unfit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(i, known) for i, own, met in zip(p.id, p.trades, p.met) for known in trades.unfit(list(own), [(m["distance"], m["known"]) for m in met])]
            yield pd.DataFrame(rows, columns=["id", "known"])

    # a firm of unknown trade between firms whose trades differ is linked to those it fits best
    one_way = alike.select("id", F.col("probe_id").alias("to"), "distance", F.col("a_trades").alias("trades"), F.col("a_known").alias("own"), F.col("b_known").alias("known"))
    other_way = alike.select(F.col("probe_id").alias("id"), F.col("id").alias("to"), "distance", F.col("b_trades").alias("trades"), F.col("b_known").alias("own"), F.col("a_known").alias("known"))
    both_ways = one_way.unionByName(other_way)
    to_known = both_ways.where((F.col("own") == "") & (F.col("known") != ""))
    open_firms = to_known.groupBy("id").agg(F.first("trades").alias("trades"), F.collect_set(F.struct("distance", "known")).alias("met")).where(F.size("met") > 1)
    apart = open_firms.mapInPandas(unfit, "id long, known string").withColumn("own", F.lit("")).withColumn("apart", F.lit(True))
    links = both_ways.join(shuffled(apart), ["id", "own", "known"], "left").select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), F.col("apart").isNotNull().alias("apart"))
    links = cut_lineage(links.groupBy("src", "dst").agg(F.max("apart").alias("apart")).where(~F.col("apart")).select("src", "dst"))
    classes = cut_lineage(nodes.select("id").join(shuffled(connected_components(links).withColumnRenamed("node", "id")), "id", "left").select("id", F.coalesce("component", "id").alias("class_id")))

    # shortened names: by the whole word, then the shortened one
    own = full.where(F.size("parts") > 1).join(shuffled(classes), "id")
    n = F.size("parts")
    first = F.struct(F.element_at("parts", 1).alias("word"), F.array_join(F.slice("parts", F.lit(2), n - 1), "").alias("other"))
    last = F.struct(F.element_at("parts", -1).alias("word"), F.array_join(F.slice("parts", F.lit(1), n - 1), "").alias("other"))
    most = F.struct(F.array_join(F.slice("parts", F.lit(1), n - 1), "").alias("word"), F.element_at("parts", -1).alias("other"))
    readings = F.when(n > 2, F.array(first, last, most)).otherwise(F.array(first, last))
    words = own.select("class_id", F.explode(readings).alias("w"), "forms", "trades", mark.alias("m")).select(
        "class_id", F.concat("m", "w.word").alias("s"), "w.word", "w.other", "forms", "trades"
    )
    cut_names = nodes.where(F.col("short").isNotNull()).select(F.col("id").alias("short_id"), F.concat(mark, "whole").alias("t"), "short", F.col("trades").alias("short_trades"))
    vocabulary = words.select("s").distinct().withColumn("id", F.xxhash64("s"))
    wanted = cut_names.select("t").distinct().withColumn("probe_id", F.xxhash64("t") + F.lit(1))
    close = edit_join(vocabulary, wanted, 1)
    by_word = close.join(shuffled(vocabulary), "id").join(shuffled(wanted), "probe_id").where(F.substring("s", 1, 1) == F.substring("t", 1, 1)).select("s", "t", "distance")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ranks = []
            for s, word, other, forms, d, x, y in zip(p["short"], p["word"], p["other"], p["forms"], p["distance"], p["trades"], p["short_trades"]):
                full_trade, own_trade = trades.known(x), trades.known(y)
                able = not trades.differ(full_trade, own_trade) and (not full_trade or all(trades.may_be(t, full_trade) for t in y if not trades.known([t])))
                found = [f for f in (fit(s, o) for o in (other, *(f.split(" ")[0] for f in forms if f.endswith(" " + word)))) if f is not None] if able else []
                # the fewest letters amiss; of equal ones a firm whose trade is the same
                ranks.append(2 * (d + min(found)) + (not set(full_trade.split()) & set(own_trade.split())) if found else -1)
            out = p[["short_id", "class_id"]].assign(rank=np.array(ranks, np.int32))
            yield out[out["rank"] >= 0]

    found = (
        cut_names.join(shuffled(by_word), "t")
        .join(shuffled(words), "s")
        .select("short_id", "short", "class_id", "distance", "word", "other", "forms", "trades", "short_trades")
        .mapInPandas(match, "short_id long, class_id long, rank int")
    )
    best = found.groupBy("short_id", "rank").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other"))
    least = best.groupBy("short_id").agg(F.min_by(F.struct("class_id", "other"), "rank").alias("b"))
    joined = cut_lineage(least.where(F.col("b.class_id") == F.col("b.other")).select(F.col("short_id").alias("id"), F.col("b.class_id").alias("joined")))
    # the others are one with equally shortened names only
    lone = nodes.where(F.col("short").isNotNull()).join(shuffled(joined), "id", "left_anti")
    equal = ["name_kind", "whole", "short", "trade_group"]
    joined = joined.unionByName(lone.join(shuffled(lone.groupBy(*equal).agg(F.min("id").alias("joined"))), equal).select("id", "joined"))
    final = classes.join(shuffled(joined), "id", "left").select("id", F.coalesce("joined", "class_id").alias("class_id"))
    degree = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    labelled = nodes.select("id", "name_kind", "core", "trade_group").join(shuffled(final), "id").join(shuffled(degree), "id", "left")
    return spelled.select("name_kind", "name", "core", "trade_group").join(shuffled(labelled), ["name_kind", "core", "trade_group"]).select("name_kind", "name", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def class_members(records: DataFrame, classes: DataFrame) -> DataFrame:
    """``name_kind``, ``key``, ``class_id``, ``links`` of each record with a name."""
    return records.select("name_kind", "key", "name").distinct().join(shuffled(classes), ["name_kind", "name"]).select("name_kind", "key", "class_id", "links")


def class_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different records within a class, the smaller key first."""
    a = members.select("name_kind", "class_id", F.col("key").alias("key_a"))
    b = members.select("name_kind", "class_id", F.col("key").alias("key_b"))
    return a.join(shuffled(b), ["name_kind", "class_id"]).where(F.col("key_a") < F.col("key_b")).select("name_kind", "key_a", "key_b").distinct()
