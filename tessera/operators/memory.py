"""Memory of episodes: ingest under the update policy, maintenance, and contexts within a budget."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.functions.vectors import cosine
from tessera.operators import policy, retrieval
from tessera.operators.engine import OPEN_END, Engine
from tessera.operators.packs import TEMPORAL
from tessera.plans.program import ANY
from tessera.sources import protocol

#: Turns after which a table of memory is stored as one, and episodes and observations of a turn up to which its slots are broadcast.
STORED_EVERY, BROADCAST_EPISODES, BROADCAST_SLOTS = 8, 1_000_000, 1_000_000
EPISODES = "id string, n long, text string, ts long, speaker string"
# fixed values: words of a question that ask for the present value
STATE_WORDS = ("current", " now", "latest", "amount", "price", "how much", "value")
# fixed values: parts of relations by which a thing leaves the set that it was in, and of those whose numbers are sums already
CONSUMED = ("watched", "read", "finished", "sold", "removed", "gave", "donated", "completed", "returned", "cancel")
STATED = ("count", "total", "number")
# fixed values: least overlap or cosine of an evidence line, what the user's own facts get more, and lines shown
EVIDENCE_OVERLAP, EVIDENCE_COSINE, OWN_BONUS, EVIDENCE_LINES, OWN = 2, 0.45, 0.25, 12, "the_user"
# fixed values: bytes of the history section, least confidence of an alias that is shown, and how many are
HISTORY_BYTES, ALIAS_CONFIDENCE, ALIAS_LINES = 2800, 0.9, 12


class Escalations(Sequence):
    """Contradictions that wait for a decision, as stored tables (i, text) in the order of i; what has been decided is left out. Only what
    is asked for comes to the driver."""

    def __init__(self, spark: SparkSession, parts: list[tuple[DataFrame, int]] | None = None) -> None:
        self.spark, self.parts, self.decided = spark, list(parts or []), []

    @classmethod
    def of(cls, spark: SparkSession, texts: list[str]) -> "Escalations":
        return cls(spark, [(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), len(texts))] if texts else [])

    def __len__(self) -> int:
        return sum(n for _, n in self.parts) - len(self.decided)

    def table(self) -> DataFrame:
        """(part, i, text) of all that wait; their order is that of part and i."""
        out = self.spark.createDataFrame([], "part int, i long, text string")
        for k, (df, _) in enumerate(self.parts):
            out = out.unionByName(df.select(F.lit(k).alias("part"), "i", "text"))
        gone = self.spark.createDataFrame(self.decided, "part int, i long")
        return out.join(F.broadcast(gone), ["part", "i"], "left_anti") if self.decided else out

    def __iter__(self):
        return (r["text"] for r in self.table().orderBy("part", "i").toLocalIterator())

    def __eq__(self, other) -> bool:
        return list(self) == list(other)

    def _row(self, index: int):
        index += len(self) if index < 0 else 0
        found = self.table().orderBy("part", "i").offset(index).limit(1).first() if 0 <= index < len(self) else None
        if found is None:
            raise IndexError(index)
        return found

    def __getitem__(self, index: int) -> str:
        return self._row(index)["text"]

    def pop(self, index: int) -> str:
        found = self._row(index)
        self.decided.append((found["part"], found["i"]))
        return found["text"]


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """(i, text) of rows with ``text``, i growing with their order; the sort is by ranges, so no task holds all rows."""
    return rows.orderBy(*by).select(F.monotonically_increasing_id().alias("i"), "text")


class Memory:
    """``extractor``: from a DataFrame of episodes (id, n, text, ts, speaker) to the same with ``text`` in the line protocol; by
    default the episodes' texts are taken as such. ``clock`` gives the time at which facts are asserted, in seconds."""

    def __init__(self, spark: SparkSession, rules: str = "", extractor: Callable[[DataFrame], DataFrame] | None = None, clock: Callable[[], int] | None = None, strict: bool = False) -> None:
        self.spark, self.extractor, self.strict = spark, extractor or (lambda df: df), strict
        self.clock = clock or (lambda: int(time.time()))
        self.engine = Engine(spark, "lineage")
        self.engine.register("edge", spark.createDataFrame([], "e string, r string, o struct<i:bigint,s:string>, vf long, vt long, at long"))
        self.engine.install(TEMPORAL)
        self.rules = rules
        if rules.strip():
            self.engine.install(rules)
        self.episodes = spark.createDataFrame([], EPISODES)
        self.escalated = Escalations(spark)
        self.n = 0
        self.turns: dict[str, int] = {}
        self.turn = 0
        self.closed = self._no_edges()
        self.open = self._no_edges()

    def _no_edges(self) -> DataFrame:
        return self.spark.createDataFrame([], "subj string, pred string, obj struct<i:bigint,s:string>, vf long, vt long, at long, conf double, prov array<string>, was array<string>")

    # ingest

    def observe(self, episodes: list[tuple] | DataFrame) -> dict:
        """Ingests episodes (text, ts[, speaker]) in their order, as one batch; returns counts of what was added, updated, merged, and
        the escalations. A DataFrame has the columns text, ts and, if it has them, id and speaker; its order is that of ts, then id."""
        if isinstance(episodes, DataFrame):
            # ids follow from content, so no task has to number all episodes
            made = F.concat(F.lit("ep"), F.hex(F.xxhash64("ts", "text")))
            speaker = F.col("speaker") if "speaker" in episodes.columns else F.lit(None).cast("string")
            ts = F.col("ts").cast("long")
            new = episodes.select((F.col("id") if "id" in episodes.columns else made).alias("id"), ts.alias("n"), "text", ts.alias("ts"), speaker.alias("speaker"))
        else:
            rows = [(f"ep{self.n + i}", self.n + i, e[0], e[1], e[2] if len(e) > 2 else None) for i, e in enumerate(episodes, 1)]
            new = self.spark.createDataFrame(rows, EPISODES)
        new = self.engine.space.stored(new)
        parse = protocol.parse_strict if self.strict else protocol.parse_lines
        rows = parse(self.extractor(new))
        self.dropped = protocol.dropped(rows)
        facts = protocol.good(rows)
        obs = facts.select(
            F.struct(F.lit(1).alias("k"), "n", "id", "line_no").alias("seq"), "ts", "subj", "pred", protocol.typed_object(F.col("obj")).alias("obj"), "conf", F.array("id").alias("prov"), F.lit(None).cast("long").alias("at")
        )
        obs = self.engine.space.stored(obs)
        slots = obs.select("subj", "pred").distinct()
        few = new.count() <= BROADCAST_EPISODES and obs.count() <= BROADCAST_SLOTS
        slots = F.broadcast(slots) if few else slots
        # only slots of this batch are decided; all other open facts stay as they are
        touched = self.engine.space.stored(self.open.join(slots, ["subj", "pred"], "left_semi").select(*self.open.columns))
        before = touched.select(F.struct(F.lit(0).alias("k"), F.col("vf").alias("n"), F.lit("").alias("id"), F.lit(0).alias("line_no")).alias("seq"), F.col("vf").alias("ts"), "subj", "pred", "obj", "conf", "prov", "at")
        exclusive = self.engine.facts("exclusive").select("p0")
        decided = self.engine.space.stored(policy.decide(before.unionByName(obs), exclusive))
        wall = self.clock()
        edges = self.engine.space.stored(policy.edges(decided, F.coalesce(F.min_by("at", "seq"), F.lit(wall))))
        fresh = decided.where("seq.k = 1")
        counts = {r["action"]: r["count"] for r in fresh.groupBy("action").count().collect()}
        n = counts.get("ESCALATE", 0)
        texts = Escalations(self.spark, [(self.engine.space.stored(in_order(policy.escalations(fresh), "seq")), n)] if n else [])
        self._take(touched, edges, slots)
        last = new.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts")).first()
        self.episodes = self._grown("episodes", self.episodes.unionByName(new))
        self.n += last["n"]
        if last["ts"] is not None:
            self.engine.set_now(last["ts"])
        self.escalated.parts += texts.parts
        return {"added": counts.get("ADD", 0) + counts.get("ESCALATE", 0), "updated": counts.get("UPDATE", 0), "noop": counts.get("NOOP", 0), "escalations": texts}

    def _take(self, touched: DataFrame, edges: DataFrame, slots: DataFrame) -> None:
        """Puts the edges of the slots of a batch in place of those that were open there; the engine gets what differs."""
        args, keys = ["subj", "pred", "obj", "vf", "vt", "at"], ["subj", "pred", "obj", "vf", "at"]
        open_ = edges.where(F.col("vt") == OPEN_END)
        gone = self.engine.space.stored(touched.join(open_.select(*keys), keys, "left_anti"))
        if gone.limit(1).count():
            self.engine.retract_all("edge", gone.select(*args))
        same = touched.select(*args, F.col("conf").alias("_c"), F.col("prov").alias("_p"))
        new = edges.join(same, args, "left").where("_c is null or _c <> conf or _p <> prov").select(*edges.columns)
        self.engine.register("edge", self.engine.space.stored(new), args=args, _conf=F.col("conf"), _prov=F.col("prov"))
        rest = self.open.join(slots, ["subj", "pred"], "left_anti").select(*self.open.columns)
        self.open = self._grown("open", rest.unionByName(open_))
        self.closed = self._grown("closed", self.closed.unionByName(edges.where(F.col("vt") != OPEN_END)))

    def _grown(self, name: str, df: DataFrame) -> DataFrame:
        """A table after one more turn; every few turns it is stored as one, so that plans don't grow with turns."""
        self.turns[name] = self.turns.get(name, 0) + 1
        if self.turns[name] < STORED_EVERY:
            return df
        self.turns[name] = 0
        return self.engine.space.stored(df)

    def observe_at(self, text: str, ts: int, speaker: str | None = None) -> dict:
        return self.observe([(text, ts, speaker)])

    def _publish(self) -> None:
        every = self.open.unionByName(self.closed)
        self.engine.replace("edge", every, args=["subj", "pred", "obj", "vf", "vt", "at"], _conf=F.col("conf"), _prov=F.col("prov"))

    def maintain(self, now: int | None = None) -> dict:
        """Derives what has changed; contexts report the news since the last call."""
        if now is not None:
            self.engine.set_now(now)
        self.turn = self.engine.epoch
        return self.engine.run()

    def resolve(self, index: int) -> str:
        return self.escalated.pop(index)

    def retract(self, text: str) -> dict:
        """Removes the open facts that lines of the protocol name: {done, missing, died}, died being the derived facts that went."""
        parsed = protocol.good(protocol.parse_strict(self.spark.createDataFrame([(text,)], "text string")))
        wanted = parsed.select("subj", "pred", protocol.typed_object(F.col("obj")).alias("obj"), F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), F.col("obj")).alias("line")).distinct()
        hit = wanted.join(self.open.select("subj", "pred", "obj", F.lit(True).alias("hit")).distinct(), ["subj", "pred", "obj"], "left").select("line", "hit").collect()
        done, missing = sorted(r["line"] for r in hit if r["hit"]), sorted(r["line"] for r in hit if not r["hit"])
        if not done:
            return {"done": done, "missing": missing, "died": []}
        derived = {p: self.engine.facts(p) for p in self.engine.derived}
        before = {p: self.engine.space.stored(df) for p, df in derived.items()}
        self.open = self.engine.space.stored(self.open.join(wanted.select("subj", "pred", "obj"), ["subj", "pred", "obj"], "left_anti").select(*self.open.columns))
        self._publish()
        self.maintain()
        died = []
        for p, old in sorted(before.items()):
            keys = [c for c in old.columns if c[0] == "p"]
            died += [self.engine.render(p, r) for r in old.join(self.engine.facts(p), keys, "left_anti").orderBy(*keys).collect()]
        return {"done": done, "missing": missing, "died": died}

    # questions

    def ask(self, goal: str, deep: bool = False) -> DataFrame:
        if deep:
            self.maintain()
        return self.engine.ask_deep(goal) if deep else self.engine.ask(goal)

    def what_if(self, text: str, goal: str) -> DataFrame:
        """Answers a goal as if the lines' facts held from now on; objects are typed as on ingest."""
        rows = protocol.good(protocol.parse_strict(self.spark.createDataFrame([(text,)], "text string"))).collect()
        number = lambda o: int(o) if o.lstrip("+-").isdigit() and o.isascii() else o
        now = self.engine.now
        return self.engine.what_if([("edge", r["subj"], r["pred"], number(r["obj"]), now, OPEN_END, self.clock()) for r in rows], goal)

    def current(self) -> DataFrame:
        """(subj, pred, obj, conf, prov) of what holds now, objects as text."""
        shown = F.coalesce(F.col("p2")["i"].cast("string"), F.col("p2")["s"]) if self.engine.types()["current"][2] == ANY else F.col("p2").cast("string")
        return self.engine.facts("current").select(F.col("p0").alias("subj"), F.col("p1").alias("pred"), shown.alias("obj"), F.col("_conf").alias("conf"), F.col("_prov").alias("prov"))

    def context(self, entities: list[str], budget_tokens: int) -> str:
        """News, the entities' facts by confidence (60 percent of the budget) and their source episodes (40 percent)."""
        line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), "obj", F.lit("   [conf "), F.format_string("%.2f", "conf"), F.lit(", prov "), F.array_join("prov", ","), F.lit("]"))
        rows = self.current().where(F.col("subj").isin(list(entities))).select(line.alias("text"), "conf", "prov")
        order = [F.desc("conf"), F.asc("text")]
        facts = retrieval.budget_prefix(rows, int(budget_tokens * 4 * 0.6), order).orderBy(*order).collect()
        used = sorted({p for r in facts for p in r["prov"]})
        left, sources = int(budget_tokens * 4 * 0.4), []
        for r in self.episodes.where(F.col("id").isin(used) if used else F.lit(False)).orderBy("n").toLocalIterator():
            block = f"[{r['id']}] {r['text']}"
            left -= len(block.encode()) + 1
            if left < 0:
                break
            sources.append(block)
        news = [f"{r['pred']}{r['args']}" for r in self.engine.changes_from(self.turn).where("kind = 'Added' and pred <> 'edge'").orderBy("epoch", "pred", "args").limit(20).collect()]
        head = ["== new in memory since last turn ==", *news, ""] if news else []
        return "\n".join([*head, "== memory (distilled, highest confidence first) ==", *[r["text"] for r in facts], "", "== source episodes (verbatim, from provenance) ==", *sources]) + "\n"

    def context_for_query(self, query: str, budget_tokens: int) -> str:
        return retrieval.render(retrieval.select(self.engine, self.episodes.select("id", "text"), query, budget_tokens))

    def attribution(self, query: str) -> DataFrame:
        """(subj, facts, asked): how many current facts of each subject touch the question's topic, and whether it names the subject."""
        q = F.array(*[F.lit(t) for t in self.spark.range(1).select(tx.stems(F.lit(query)).alias("s")).first()["s"]] or [F.lit("")])
        line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), "obj")
        rows = self.current().select("subj", (tx.topic_overlap(tx.stems(line), F.col("subj"), q) >= 1).cast("int").alias("hit"))
        asked = F.exists(tx.stems(F.col("subj")), lambda t: (F.octet_length(t) >= 3) & F.array_contains(q, t))
        return rows.groupBy("subj").agg(F.sum("hit").alias("facts")).withColumn("asked", asked)

    def slots(self, query: str | None = None) -> DataFrame:
        """(subj, pred, latest, older): slots that had several values, newest first, with at most three older ones."""
        shown = F.coalesce(F.col("obj")["i"].cast("string"), F.col("obj")["s"])
        rows = self.open.unionByName(self.closed).select("subj", "pred", shown.alias("obj"), "vf")
        if query is not None:
            q = F.array(*[F.lit(t) for t in self.spark.range(1).select(tx.stems(F.lit(query)).alias("s")).first()["s"]] or [F.lit("")])
            line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), "obj")
            rows = rows.where(F.exists(tx.stems(line), lambda t: (F.octet_length(t) >= 3) & F.array_contains(q, t)))
        return latest_per_slot(rows)

    def _stems(self, query: str) -> Column:
        """The question's stems as an array of literals."""
        return F.array(*[F.lit(t) for t in self.spark.range(1).select(tx.stems(F.lit(query)).alias("s")).first()["s"]] or [F.lit("")])

    def counts(self, query: str) -> DataFrame:
        """(subj, pred, n, gone, stated): of the slots on a counting question's topic, how many things they hold, how many of them have left
        since (another of the subject's relations says sold, read, ... of something with a word in common), and the latest number
        that was stated as such. A value that is a run of another value's words is the same thing under a shorter name."""
        q = self._stems(query)
        line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), "obj")
        everything = self.engine.space.stored(self.current().select("subj", "pred", "obj"))
        rows = everything.where(tx.topic_overlap(tx.stems(line), F.col("subj"), q) >= 1)
        number = F.col("obj").try_cast("bigint")
        things = rows.where(number.isNull()).select("subj", "pred", F.lower("obj").alias("name")).distinct()
        ws = F.split("name", "[ _]+")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ws)), lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))))
        longer = things.select("subj", "pred", F.explode(F.array_except(F.array_distinct(runs), F.array(F.array_join(ws, " ")))).alias("name")).distinct()
        held = things.withColumn("name", F.array_join(ws, " ")).join(longer, ["subj", "pred", "name"], "left_anti").distinct()
        left = everything.where(F.lower("pred").rlike("|".join(CONSUMED))).select("subj", F.explode(tx.stems(F.col("obj"))).alias("word")).distinct()
        words = held.where(~F.lower("pred").rlike("|".join(CONSUMED))).select("subj", "pred", "name", F.explode(tx.stems(F.col("name"))).alias("word"))
        gone = words.join(left, ["subj", "word"], "left_semi").groupBy("subj", "pred").agg(F.count_distinct("name").alias("gone"))
        sizes = held.groupBy("subj", "pred").agg(F.count_distinct("name").alias("n"))
        said = self.open.where(F.col("obj.i").isNotNull()).groupBy("subj", "pred").agg(F.max_by("obj.i", "vf").alias("stated"))
        topic = rows.select("subj", "pred").distinct()
        out = topic.join(sizes, ["subj", "pred"], "left").join(gone, ["subj", "pred"], "left").join(said, ["subj", "pred"], "left")
        return out.select("subj", "pred", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("gone", F.lit(0)).alias("gone"), "stated")

    def sums(self) -> DataFrame:
        """(subj, pred, total, entries) of the distinct numbers of each slot in ``numeric(subject, relation, number)``; relations that state
        counts or totals aren't added up. One aggregation for all relations."""
        if "numeric" not in self.engine.types():
            return self.spark.createDataFrame([], "subj string, pred string, total long, entries long")
        rows = self.engine.facts("numeric").select(F.col("p0").alias("subj"), F.col("p1").alias("pred"), F.col("p2").alias("n"))
        return rows.where(~F.lower("pred").rlike("|".join(STATED))).groupBy("subj", "pred").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))

    def evidence(self, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, most: int = EVIDENCE_LINES) -> DataFrame:
        """(line, score): the current facts that bear on a question, by words in common other than the subject's, or by the cosine of
        their vectors (id, the fact's text as retrieval has it, and v) to the question's; the user's own facts weigh a little more."""
        line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), "obj")
        rows = self.current().select("subj", line.alias("line"), F.concat(F.lit("current("), F.concat_ws(", ", "subj", "pred", "obj"), F.lit(")")).alias("id"))
        rows = rows.withColumn("overlap", tx.topic_overlap(tx.stems(F.col("line")), F.col("subj"), self._stems(query)))
        close = F.lit(0.0)
        if vectors is not None and query_vector:
            rows = rows.join(vectors.select("id", "v"), "id", "left")
            near = cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in query_vector])) + F.when(F.col("subj") == OWN, OWN_BONUS).otherwise(0.0)
            close = F.when(F.size("v") > 0, F.coalesce(near, F.lit(0.0))).otherwise(F.lit(0.0))
        rows = rows.withColumn("close", close).where((F.col("overlap") >= EVIDENCE_OVERLAP) | (F.col("close") > EVIDENCE_COSINE))
        score = F.when(F.col("overlap") >= EVIDENCE_OVERLAP, 2.0 + F.col("overlap")).otherwise(F.col("close"))
        return rows.groupBy("line").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "line").limit(most)

    def _asked_about(self, query: str, *names: str) -> Column:
        """Whether one of the names has a token of the question, of three bytes or more."""
        asked = self.spark.range(1).select(F.filter(tx.tokens(F.lit(query)), lambda t: F.octet_length(t) >= 3).alias("t")).first()["t"]
        hit = F.lit(False)
        for n in names:
            hit = hit | F.exists(tx.tokens(F.col(n)), lambda t: t.isin(asked) if asked else F.lit(False))
        return hit

    def edge_history(self, query: str, most_bytes: int = HISTORY_BYTES) -> list[str]:
        """Lines of all facts ever held of the subjects that a question names: from when to when, and when asserted, as long as they fit."""
        shown = F.coalesce(F.col("obj")["i"].cast("string"), F.col("obj")["s"])
        end = F.when(F.col("vt") == OPEN_END, F.lit("open")).otherwise(F.col("vt").cast("string"))
        line = F.concat("subj", F.lit(" --"), "pred", F.lit("--> "), shown, F.lit(", "), F.col("vf").cast("string"), F.lit(" .. "), end, F.lit(" (asserted "), F.col("at").cast("string"), F.lit(")"))
        rows = self.open.unionByName(self.closed).where(self._asked_about(query, "subj")).select(line.alias("text"), "subj", "pred", "vf")
        order = [F.asc("subj"), F.asc("pred"), F.asc("vf"), F.asc("text")]
        return [r["text"] for r in retrieval.budget_prefix(rows, most_bytes, order).orderBy(*order).collect()]

    def alias_lines(self, query: str) -> list[str]:
        """Aliases of what a question names that are sure enough to be shown."""
        if "alias" not in self.engine.types():
            return []
        rows = self.engine.facts("alias").where(F.col("_conf") >= ALIAS_CONFIDENCE).where(self._asked_about(query, "p0", "p1"))
        return [f"{r['p0']} = {r['p1']}" for r in rows.orderBy("p0", "p1").limit(ALIAS_LINES).collect()]

    def recall(self, query: str, extract: Callable[[str, list[tuple[str, str]]], str], budget_tokens: int = 1200) -> list[str]:
        """A second look where memory has no answer: the episodes that rank first for the question go to ``extract``, with the question,
        and what it gives in the line protocol comes back as lines. Nothing is stored."""
        chosen = retrieval.select(self.engine, self.episodes.select("id", "text"), query, budget_tokens)["episodes"]
        if not chosen:
            return []
        answer = extract(query, chosen)
        if answer.strip().lower() == "none":
            return []
        rows = protocol.good(protocol.parse_strict(self.spark.createDataFrame([(answer,)], "text string")))
        return [f"{r['subj']} --{r['pred']}--> {r['obj']}" for r in rows.orderBy("line_no").collect()]

    def context_for_query_rich(self, query: str, budget_tokens: int) -> str:
        out = [self.context_for_query(query, budget_tokens).rstrip("\n")]
        holders = self.attribution(query)
        top = holders.where("facts > 0").orderBy(F.desc("facts"), "subj").limit(6).collect()
        none = [r["subj"] for r in holders.where("asked and facts = 0").orderBy("subj").limit(50).collect()]
        if top or none:
            out += ["", "ATTRIBUTION (who holds facts on this question's topic, by subject):", *[f"  {r['subj']}: {r['facts']} topic facts" for r in top]]
            if none:
                out.append(f"  NO topic facts for: {', '.join(none)} (mentioned in the question)")
        if self.spark.range(1).select(tx.is_counting_question(F.lit(query)).alias("c")).first()["c"]:
            rows = self.counts(query).orderBy("subj", "pred").limit(8).collect()
            if rows:
                out += ["", "COUNTS (things held per slot on this question's topic):"]
                told = lambda r: (f", {r['gone']} of them gone since" if r["gone"] else "") + (f" (stated: {r['stated']})" if r["stated"] is not None else "")
                out += [f"  {r['subj']} --{r['pred']}--> {r['n']}{told(r)}" for r in rows]
            q = self._stems(query)
            about = self.sums().where(F.exists(tx.stems(F.concat_ws(" ", "subj", "pred")), lambda t: (F.octet_length(t) >= 3) & F.array_contains(q, t)))
            rows = about.orderBy("subj", "pred").limit(8).collect()
            if rows:
                out += ["", "SUMS (amounts added up per slot):", *[f"  {r['subj']} --{r['pred']}--> {r['total']} ({r['entries']} entries)" for r in rows]]
        if any(w in query.lower() for w in STATE_WORDS):
            rows = self.slots(query).orderBy("subj", "pred").limit(8).collect()
            if rows:
                out += ["", "CURRENT STATE (latest value per slot; superseded values listed as history):"]
                out += [f"  {r['subj']} --{r['pred']}--> {r['latest']} (current; superseded: {', '.join(r['older'])})" for r in rows]
        history = self.edge_history(query)
        if history:
            out += ["", "EDGE HISTORY (subject --relation--> object, from .. to, asserted at):", *[f"  {x}" for x in history]]
        names = self.alias_lines(query)
        if names:
            out += ["", "ENTITY ALIASES (same entity, reconciled):", *[f"  {x}" for x in names]]
        return "\n".join(out) + "\n"


def latest_per_slot(rows: DataFrame, older: int = 3) -> DataFrame:
    """From (subj, pred, obj, vf) the slots with several distinct values: (subj, pred, latest, older array), newest first."""
    last = rows.groupBy("subj", "pred", "obj").agg(F.max("vf").alias("vf"))
    ranked = last.withColumn("k", F.row_number().over(Window.partitionBy("subj", "pred").orderBy(F.desc("vf"), "obj"))).where(F.col("k") <= older + 1)
    out = ranked.groupBy("subj", "pred").agg(F.array_sort(F.collect_list(F.struct("k", "obj"))).alias("v")).where(F.size("v") > 1)
    return out.select("subj", "pred", F.col("v")[0]["obj"].alias("latest"), F.transform(F.slice("v", 2, older), lambda x: x["obj"]).alias("older"))


def first_mentions(edges: DataFrame) -> DataFrame:
    """(name, first): the earliest time at which each entity was asserted, from (subj, obj, at)."""
    both = edges.select(F.col("subj").alias("name"), "at").unionByName(edges.select(F.col("obj").alias("name"), "at"))
    return both.where("name is not null").groupBy("name").agg(F.min("at").alias("first"))


def date_differences(dated: DataFrame, most: int = 6) -> DataFrame:
    """(a, b, days) between the first ``most`` events of (event, ymd) that have a date: a report for a reader."""
    few = dated.groupBy("event").agg(F.min("ymd").alias("ymd")).orderBy("ymd", "event").limit(most)
    a = few.select(F.col("event").alias("a"), F.col("ymd").alias("da"))
    b = few.select(F.col("event").alias("b"), F.col("ymd").alias("db"))
    return a.join(b, (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))).select("a", "b", (tx.days_of(F.col("db")) - tx.days_of(F.col("da"))).alias("days"))
