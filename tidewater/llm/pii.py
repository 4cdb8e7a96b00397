"""Personal data: base patterns plus information-theoretic sanitisation of the terms that give them away."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import extended, map_batches, materialise, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")

#: A term and an entity must meet in more texts than chance explains, at this level over all their pairs (copies of a text are one).
LEVEL = 0.05
#: Share of an entity's information content that a term discloses, from which it is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: So many terms go to every task as a set; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: What a term is generalised to, by whether it begins with a capital.
GENERAL = {True: "<NAME>", False: "<WORD>"}
#: Parts that the terms of one text are copied to where they come by a shuffle, so that a text that repeats often is not one key.
SALTS = 32


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain; linear in the text, since a local part ends at its @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        run = at - free
        local = run - len(text[free:at].rstrip(LOCAL)) if run else 0
        free = at + 1
        if local and (m := DOMAIN.match(text, at + 1)):
            out.append((at - local, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A chain of dotted numbers holds a match for each four numbers from its start."""
    out = []
    for m in DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") >= 3:
            parts, at = chain.split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((at, end))
                at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), by start, then kind."""
    if not text:
        return []
    return sorted((s, e, k) for k, kind in enumerate(BASE) for s, e in FINDERS[kind](text))


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A mention's entity, whatever way it is written, as a hash."""
    start, end, kind = span
    value = text[start:end].lower() if kind < 2 else re.sub("[^0-9]", "", text[start:end])
    return xxhash.xxh64_intdigest(f"{BASE[kind]}:{value}") - 2**63


def contexts(docs: DataFrame, text_col: str) -> DataFrame:
    """A row (entity, term, context) for each document, entity in it and term anywhere in it, and one with a null term. The context
    is the text's hash."""

    def run(batches):
        for pdf in batches:
            for text in pdf[text_col]:
                spans = base_spans(text)
                if not spans:
                    continue
                inside = bytearray(len(text))
                for s, e, _ in spans:
                    inside[s:e] = b"\1" * (e - s)
                terms = {m.group().lower() for m in TERM.finditer(text) if not any(inside[m.start() : m.end()])}
                where = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
                for ent in {entity(text, span) for span in spans}:
                    yield pd.DataFrame({"entity": ent, "term": pd.Series([None, *terms], dtype=object), "context": where})

    return map_batches(docs.select(text_col), run, "entity long, term string, context long")


def term_counts(docs: DataFrame, candidates: DataFrame, text_col: str, broadcast_terms: int) -> DataFrame:
    """Documents that hold each candidate term: (term, n)."""
    few = [r["term"] for r in candidates.limit(broadcast_terms + 1).collect()]
    wanted = frozenset(few) if len(few) <= broadcast_terms else None

    def run(batches):
        counts: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf[text_col]:
                if text:
                    found = set(TERM.findall(text.lower()))
                    counts.update(found & wanted if wanted is not None else found)
            if len(counts) > 500_000:
                yield pd.DataFrame(list(counts.items()), columns=["term", "n"])
                counts.clear()
        if counts:
            yield pd.DataFrame(list(counts.items()), columns=["term", "n"])

    counted = map_batches(docs.select(text_col), run, "term string, n long")
    if wanted is None:
        counted = counted.join(candidates, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(
    docs: DataFrame, text_col: str = "text", level: float = LEVEL, generalise: float = GENERALISE,
    remove: float = REMOVE, broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Terms that give an entity away: (term, entity, disclosure, action).

    Over all documents: PMI(term; entity) = log2(n(term, entity) * N / (n(term) * n(entity))), as a share of the entity's
    information content log2(N / n(entity)). 1 means that the term occurs with the entity only. Pairs count whose term and entity meet
    in significantly many different texts: Hoeffding's bound of the hypergeometric tail, times the number of pairs of an entity and a
    term, is ``level`` at most. Null and empty texts only count among all documents; an empty table gives no terms.
    """
    seen = contexts(docs, text_col).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("together"), F.count_distinct("context").alias("support")
    )
    spark = docs.sparkSession
    seen = materialise(seen, "pii-contexts")
    pairs = seen.where("term is not null")
    none = spark.createDataFrame([], "term string, entity long, disclosure double, action string")
    entities, terms = seen.agg(F.count_distinct("entity"), F.count_distinct("term")).first()
    if not terms:
        return none
    texts = float(docs.select(F.xxhash64(text_col)).distinct().count())
    total = float(docs.count())
    alone = seen.where("term is null").select("entity", F.col("together").alias("of_entity"), F.col("support").alias("of_texts"))

    def chance(holds):
        """Log of the bound for meeting in ``support`` of the entity's texts when a term stands in ``holds`` of all."""
        k, q = F.col("support") / F.col("of_texts"), F.least(holds / F.lit(texts), F.lit(1.0))
        rest = F.when(k < 1, (1 - k) * F.log((1 - k) / F.greatest(1 - q, F.lit(1e-300)))).otherwise(0.0)
        return F.when(k > q, -F.col("of_texts") * (k * F.log(k / q) + rest)).otherwise(0.0) + F.log(F.lit(float(entities * terms)))

    # no term stands in fewer texts than it meets the entity in, so that this drops none that the test would keep
    pairs = materialise(pairs.join(alone, "entity").where(chance(F.col("support")) <= F.log(F.lit(level))), "pii-pairs")
    if not pairs.limit(1).count():
        return none
    of_term = term_counts(docs, pairs.select("term").distinct(), text_col, broadcast_terms)
    content = F.log2(F.lit(total) / F.col("of_entity"))
    shared = F.log2(F.col("together") * F.lit(total) / (F.col("n") * F.col("of_entity")))
    found = (
        pairs.join(of_term, "term").where(chance(F.col("n")) <= F.log(F.lit(level)))
        .select("term", "entity", F.when(content > 0, shared / content).otherwise(0.0).alias("disclosure"))
        .where(F.col("disclosure") >= generalise)
    )
    return materialise(
        found.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")), "pii-terms"
    )


def annotate(docs: DataFrame, terms: DataFrame, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Adds pii_spans (kind, start, end, action; code points, end exclusive) and pii_text, the sanitised text.

    Base spans are replaced by their kind's placeholder. Of the terms, those that give away an entity of the same text are generalised to
    the class of their word or removed; a text without an entity stays as it is. Null text: no spans, null
    pii_text. Where spans overlap, the first (by start, then kind) is replaced up to the end of the last.
    Repeated rows: each is annotated. Empty tables: empty result. Columns named pii_spans, pii_text are replaced, those whose names begin
    with ``_pii_`` are dropped.
    """
    docs = docs.drop("pii_spans", "pii_text", *(c for c in docs.columns if c.startswith("_pii_")))
    schema = extended(docs, "pii_spans array<struct<kind:string,start:int,end:int,action:string>>, pii_text string")
    rows = terms.select("term", "entity", "action").limit(broadcast_terms + 1).collect()
    known: dict[str, dict[int, str]] | None = None
    if len(rows) <= broadcast_terms:
        known = {}
        for r in rows:
            known.setdefault(r["term"], {})[r["entity"]] = r["action"]
        source = docs
    else:
        keyed = docs.withColumn("_pii_key", F.xxhash64(text_col)).withColumn("_pii_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))

        def words(batches):
            for pdf in batches:
                out = []
                for k, t in zip(pdf["_pii_key"], pdf[text_col]):
                    entities = {entity(t, span) for span in base_spans(t)}
                    out += [(k, e, w) for w in set(TERM.findall(t.lower())) for e in entities] if entities else []
                yield pd.DataFrame(out, columns=["_pii_key", "entity", "term"])

        held = (
            map_batches(keyed.select("_pii_key", text_col), words, "_pii_key long, entity long, term string").distinct()
            .join(terms, ["term", "entity"]).groupBy("_pii_key", "term").agg(F.max("action").alias("action"))
            .groupBy("_pii_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_pii_terms"))
            .withColumn("_pii_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        )
        source = keyed.join(held, ["_pii_key", "_pii_salt"], "left").drop("_pii_key", "_pii_salt")

    def of_text(text: str, spans: list) -> dict[str, str]:
        """Action for each disclosing term of a text; the stronger one, if it discloses several entities."""
        entities = {entity(text, span) for span in spans}
        out = {}
        for word in known.keys() & set(TERM.findall(text.lower())):
            actions = [known[word][e] for e in entities & known[word].keys()]
            if actions:
                out[word] = max(actions)  # remove is after generalise
        return out

    def run(batches):
        for pdf in batches:
            per = pdf["_pii_terms"] if known is None else [None] * len(pdf)
            spans, texts = [], []
            for text, actions in zip(pdf[text_col], per):
                base = base_spans(text)
                found = [(s, e, k, "generalise") for s, e, k in base]
                if base:
                    actions = of_text(text, base) if known is not None else dict(actions) if actions is not None else {}
                    found += [(m.start(), m.end(), 4, actions[w]) for m in TERM.finditer(text) if (w := m.group().lower()) in actions]
                    found.sort(key=lambda x: (x[0], x[2]))
                spans.append([(KINDS[k], s, e, a) for s, e, k, a in found])
                texts.append(sanitised(text, found))
            yield pdf.drop(columns="_pii_terms", errors="ignore").assign(
                pii_spans=[[dict(zip(("kind", "start", "end", "action"), x)) for x in s] for s in spans], pii_text=texts
            )

    return map_batches(source, run, schema)


def sanitised(text: str | None, found: list[tuple[int, int, int, str]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for start, end, kind, action in found:
        if start >= at:
            general = PLACEHOLDER.get(KINDS[kind]) or GENERAL[text[start].isupper()]
            out += [text[at:start], "" if action == "remove" else general]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Estimate the disclosing terms over all documents, then annotate them all."""
    return annotate(docs, disclosing_terms(docs, text_col), text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sanitise(docs).drop("text", "pii_text")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
    )
