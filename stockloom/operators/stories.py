"""Company news as events: which articles tell one event, found in order of time with a bounded state.

The rule in words. A story begins with an article; later ones join the earliest story that shares two keys with its first
article and heard of it in the last four days. When nothing more can join a story, it is settled: it tells the event of the earliest
story before it that is an event of its own, that turns the same way (a denial or withdrawal is news of its own), and that either began at
most four days before and has like wording (cosine of summed TF-IDF vectors) or the same once-a-window kind (results, layoffs), or is a
deal as well, began at most seven days before and names the same party. Otherwise it is an event of its own.

Nothing reaches over more than seven days, so the articles of a name are cut into runs at such gaps, runs are dealt over tasks, and a task
reads its rows sorted, with the stories of the last days as its only state: inverted lists from keys and words to open and recent
stories, from which shared keys and dot products are summed. A name with articles every day for years is one run and streams through.
"""

from __future__ import annotations

from collections import Counter, OrderedDict, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.news import ascii_words, has

#: Fixed values, whole: capitalised words that are no key of a story.
NO_KEY = """The A An And Of To In On For With As At By Its It Is Are After Stock Shares Says Inc Corp Co New Why How What This That Over From Into Up Down Report Reports
Q1 Q2 Q3 Q4 US U.S. Phase Trial Price Target Analyst Analysts Buy Hold Sell Rating Billion Million CEO CFO Here Wall Street AI""".split()
#: Fixed values, whole: keys that never name the other party of a deal.
NO_PARTY = """monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
nasdaq nyse reuters bloomberg takeover acquisition merger deal bid rumors even buyout offer""".split()
#: Fixed values, whole: words that carry no story.
NO_STORY = """about above after again against all also and any are because been before being below between both but can could did does doing down during each few for from
further had has have having her here hers him his how into its just more most nor not now off once only other our out over own same she should some such than that the their
them then there these they this those through too under until very was were what when where which while who whom why will with would you your says said new stock stocks
shares share inc corp company report reports reported according week today year years first one two three per million billion percent amid may likely""".split()
#: Fixed values, whole (no case): developments that change a story; kinds that come once a window, each with what it must not hold; deals.
TURNS = [r"den(y|ies|ied)", r"rules? out", r"ruled out", r"walks? away", r"withdr[ae]w\w*", r"abandon\w*", r"terminat\w*", r"calls? off", r"scrap\w*", r"rejects?", r"rejected", r"completes", r"closes", r"blocks?", r"blocked"]
ONCE = [
    (r"(\bq[1-4]\b|quarter|results|earnings|\beps\b)", r"\b(trial|study|phase|data|dividend)\b"),
    (r"layoffs?|\blay(s|ing)? off\b|job cuts|\bcuts? .{0,20}\bjobs\b|\b(cut|cuts|cutting|reduc\w*|trim\w*|shrink\w*) .{0,20}workforce", None),
]
DEALS = [
    r"acqui", r"merger", r"takeover", r"buyout", r"\bbids?\b", r"tie-?up", r"megadeal", r"\bbuys\b",
    r"\b(plans?|agrees?|agreed|offers?|offered|seeks?|wants?|eyes|eyeing|considers?|considering|explores?|explored|exploring|weighs?|weighing|talks) to buy\b",
]
DAY = 86_400
#: Seconds in which a story is heard of, and a deal; keys to share; wording taken as like.
WINDOW, DEAL_WINDOW, SHARED, LIKE = 4 * DAY, 7 * DAY, 2, 0.20
KEY, WORD = r"(\$?\d[\d.,]*[bmk%]?|[A-Z][\w&'’-]*)", r"([a-z0-9$%][a-z0-9$%.'-]*[a-z0-9%])"


def keys(text: Column, own: Column | None = None) -> Column:
    """Figures and capitalised words that tell a story from another, lower case; without the company's own words."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(KEY), 1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^['’]+|['’]+$", ""), r"[.,]+$", ""))
    found = F.array_distinct(F.transform(F.filter(bare, lambda x: ~x.isin(NO_KEY) & (F.length(x) >= 2)), F.lower))
    return found if own is None else F.array_except(found, own)


def own_words(ticker: Column, name: Column | None = None) -> Column:
    """Words that name the company itself."""
    words = F.array(F.lower(ticker.cast("string")))
    return words if name is None else F.array_union(words, F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([A-Za-z][\w&'-]*)"), 1), F.lower))


def marks(headline: Column) -> dict[str, Column]:
    """turn, deal, once (numbers of its once-a-window kinds) of a headline."""
    h = ascii_words(headline)
    kinds = [F.when(has(h, p) & (~has(h, x) if x else F.lit(True)), F.lit(i)) for i, (p, x) in enumerate(ONCE)]
    return {"turn": has(h, r"\b(" + "|".join(TURNS) + r")\b"), "deal": has(h, "|".join(DEALS)), "once": F.array_compact(F.array(*kinds))}


def weights(articles: DataFrame) -> DataFrame:
    """id, words, w: normed TF-IDF of headline and the start of the summary; document counts are those of the company's articles."""
    text = F.lower(F.concat_ws(" ", "headline", F.substring("summary", 1, 300)))
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), 1), lambda x: (F.length(x) >= 3) & ~x.isin(NO_STORY) & ~F.array_contains("own", x))
    bag = articles.select("ticker", "id", F.explode(words).alias("word")).groupBy("ticker", "id", "word").agg(F.count("*").alias("c"))
    seen = bag.groupBy("ticker", "word").agg(F.count("*").alias("df"))
    size = articles.groupBy("ticker").agg(F.count("*").alias("n"))
    v = bag.join(seen, ["ticker", "word"]).join(size, "ticker").withColumn("v", (1 + F.ln("c")) * F.ln((1 + F.col("n")) / (1 + F.col("df"))))
    g = v.groupBy("ticker", "id").agg(F.collect_list(F.struct("word", "v")).alias("x"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # words of one short text
    return g.select("ticker", "id", F.transform("x", lambda e: e["word"]).alias("words"), F.transform("x", lambda e: F.when(F.col("norm") > 0, e["v"] / F.col("norm")).otherwise(0.0)).alias("w"))


@dataclass
class Story:
    number: int
    first: int
    last: int
    seed: list[str]
    bag: Counter = field(default_factory=Counter)
    face: tuple = ()  # (grade, -time), keys, deal, turn, once of the strongest, earliest article


class Run:
    """The open and the recent stories of one run of articles, fed in order of time."""

    def __init__(self) -> None:
        self.count = 0
        self.open: OrderedDict[int, Story] = OrderedDict()  # by when they were last heard of
        self.by_key: dict[str, set[int]] = defaultdict(set)
        self.waiting: deque[Story] = deque()  # not settled, in order of their beginning
        self.events: deque[Story] = deque()  # events of their own that later stories may tell
        self.by_word: dict[str, dict[int, float]] = defaultdict(dict)
        self.alive: dict[int, Story] = {}

    def push(self, a) -> tuple[int, list[tuple[int, int]]]:
        """The story that an article belongs to, and the stories settled meanwhile with the event that each tells."""
        while self.open and next(iter(self.open.values())).last < a.sec - WINDOW:
            number, story = self.open.popitem(last=False)
            for k in story.seed:
                self.by_key[k].discard(number)
                if not self.by_key[k]:
                    del self.by_key[k]
        settled = self.settle()
        shared = Counter(n for k in a.keys for n in self.by_key.get(k, ()))
        fits = [n for n, c in shared.items() if c >= SHARED]
        if fits:
            story = self.open[min(fits)]
        else:
            story = Story(self.count, a.sec, a.sec, list(a.keys))
            self.count += 1
            self.open[story.number] = story
            self.waiting.append(story)
            for k in story.seed:
                self.by_key[k].add(story.number)
        story.last = a.sec
        self.open.move_to_end(story.number)
        for word, w in zip(a.words if a.words is not None else (), a.w if a.w is not None else (), strict=True):
            story.bag[word] += w
        if not story.face or (a.grade, -a.sec) > story.face[0]:
            story.face = ((a.grade, -a.sec), set(a.keys), a.deal, a.turn, set(a.once))
        return story.number, settled

    def settle(self, all_: bool = False) -> list[tuple[int, int]]:
        out = []
        while self.waiting and (all_ or self.waiting[0].number not in self.open):
            story = self.waiting.popleft()
            while self.events and self.events[0].first < story.first - DEAL_WINDOW:
                self._forget(self.events.popleft())
            out.append((story.number, self._event(story)))
        return out

    def _event(self, s: Story) -> int:
        norm = sum(x * x for x in s.bag.values()) ** 0.5 or 1.0
        s.bag = Counter({word: x / norm for word, x in s.bag.items()})
        _, named, deal, turn, once = s.face
        party = (named | set(s.seed)) - set(NO_PARTY)
        s.face = (party, deal, turn, once)
        like: Counter = Counter()
        for word, x in s.bag.items():
            for n, y in self.by_word.get(word, {}).items():
                like[n] += x * y
        for e in self.events:  # of the last seven days, the earliest first
            apart = s.first - e.first
            near = apart <= WINDOW and (like[e.number] >= LIKE or e.face[3] & once)
            if e.face[2] == turn and (near or (deal and e.face[1] and e.face[0] & party)):
                return e.number
        self.events.append(s)
        for word, x in s.bag.items():
            self.by_word[word][s.number] = x
        return s.number

    def _forget(self, e: Story) -> None:
        for word in e.bag:
            self.by_word[word].pop(e.number, None)
            if not self.by_word[word]:
                del self.by_word[word]


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ticker, run, time and id: (id, story) of each article, and (no id, story, event) of each settled story."""
    at, run = None, Run()
    for rows in batches:
        out = []
        for a in rows.itertuples(index=False):
            if (a.ticker, a.run) != at:
                out += [(*at, None, n, e) for n, e in run.settle(True)] if at else []
                at, run = (a.ticker, a.run), Run()
            story, settled = run.push(a)
            out += [(*at, a.id, story, None)] + [(*at, None, n, e) for n, e in settled]
        yield pd.DataFrame(out, columns=["ticker", "run", "id", "story", "event"]).astype({"story": "Int64", "event": "Int64", "run": "Int64", **({"id": "Int64"} if rows["id"].dtype.kind == "i" else {})})
    if at:
        yield pd.DataFrame([(*at, None, n, e) for n, e in run.settle(True)], columns=["ticker", "run", "id", "story", "event"]).astype({"story": "Int64", "event": "Int64", "run": "Int64"})


def clusters(articles: DataFrame) -> DataFrame:
    """Articles (ticker, id, ts, headline, summary, grade, perhaps name) with the event that they belong to (run, event). Columns
    other than these stay; an id is one of its ticker."""
    by_time = Window.partitionBy("ticker").orderBy("ts", "id")
    sec = F.col("ts").cast("long")
    named = articles.withColumn("own", own_words(F.col("ticker"), F.col("name") if "name" in articles.columns else None))
    gap = F.when(sec - F.lag(sec).over(by_time) > DEAL_WINDOW, 1).otherwise(0)
    text = F.concat_ws(" ", "headline", F.substring("summary", 1, 160))
    rows = named.select("ticker", "id", sec.alias("sec"), "grade", keys(text, F.col("own")).alias("keys"), gap.alias("gap"), *[c.alias(n) for n, c in marks(F.coalesce("headline", F.lit(""))).items()])
    runs = rows.withColumn("run", F.sum("gap").over(Window.partitionBy("ticker").orderBy("sec", "id").rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    kind = dict(articles.dtypes)
    ready = runs.join(weights(named), ["ticker", "id"], "left").repartition("ticker", "run").sortWithinPartitions("ticker", "run", "sec", "id")
    told = ready.mapInPandas(_told, f"ticker {kind['ticker']}, run long, id {kind['id']}, story long, event long")
    first = told.where("id is not null").select("ticker", "run", "id", "story")
    events = told.where("id is null").select("ticker", "run", "story", "event")
    return articles.join(first.join(events, ["ticker", "run", "story"]).drop("story"), ["ticker", "id"])


def top_events(clustered: DataFrame, most: int, cap: int = 5) -> DataFrame:
    """The ``most`` events of each ticker by strength, reports (at most ``cap`` count) and recency, shown newest first: ticker, run, event, face
    (id of its strongest, earliest article), reports, first_ts, last_ts, place. Events whose face names none drop out."""
    face = F.max_by("id", F.struct("grade", -F.col("ts").cast("long"), -F.xxhash64("id")))
    g = clustered.groupBy("ticker", "run", "event").agg(face.alias("face"), F.max("grade").alias("grade"), F.count("*").alias("reports"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("grade > 0")
    best = Window.partitionBy("ticker").orderBy(F.desc("grade"), F.desc(F.least("reports", F.lit(cap))), F.desc("last_ts"), "run", "event")
    kept = g.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("first_ts"), "run", "event"))).drop("__n", "grade")
