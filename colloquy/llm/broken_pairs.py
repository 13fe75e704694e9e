"""Broken prompt and response pairs.

Each pair gets at most one defect, the first of: empty_answer, copied_question,
other_language, refusal, truncated_answer.

* Copies: the response is compressed with its prompt as a zstandard dictionary, and the prompt
  with the response. A copy adds hardly anything to its prompt, is hardly longer, and lacks
  hardly anything of it; a prompt that is repeated and then answered adds the answer.
* Language and refusal: dictionaries (fixed values below, parameters of the operator).
* Breaking off: a terminal-context model. Over all responses the last words before
  sentence ends and before any other position are counted, and an ending counts as
  complete where its context ends sentences at least as often as not.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import checkpoint, salted_join

#: Frequent function words of each language.
STOP_WORDS = {
    "en": """the of and to in a is that was for on are with as we our be by from have this which it at an or not but will would
        can could how what why you your i do does did has had were been than then they their there if so up down about into
        through while where when who more most very also let me us just no yes because although should over he she his her its
        them these those some any each between after before during under again out all both other same only own such""",
    "de": """der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie
        nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein
        wurde wir uns unser unsere unserer ihnen ich können wurden weil warum wieder davon einen eines ihre ihrer darüber dazu
        bitte kein keine wenn dann hier dort sehr schon diese dieser dieses diesem zwischen ohne gegen unter etwa rund beim vom
        ins was wer wo welche welcher kann wird würde sollte bleibt bleiben gibt""",
    "es": """el la los las de que y en un una por con para se del al es lo como más pero sus su le ya o este sí porque esta entre
        cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
        ellos antes qué cómo cuál nuestra nuestro nuestros nuestras según parte hoy todavía ha han he hemos son está están fue
        ser era sido cada mientras aunque tras unos unas esa esos estos si no yo usted ustedes podría podrían cerca""",
    "fr": """le la les de des du un une et en que qui dans ce il elle au aux pour pas par sur se plus avec son sa ses est nous vous
        ne on mais ou où comme si leur leurs y cette été sont ont était être fait notre votre nos vos d l n s j c qu à très bien
        car sans sous entre après avant même ces aussi quelle quel pourquoi près jusqu je sera cet tout tous toute toutes dont
        ainsi depuis pendant chez vers encore lorsque donc ni ici là moins""",
    "it": """il lo la i gli le di che e è un una uno in per con non si da del della dei delle degli al alla ai alle nel nella sono
        come ma anche più ha hanno questo questa o se ci noi nostro nostra sul sulla dal dalla tra perché quando dove molto
        siamo essere stato stata ancora così loro quale cosa tutto tutti""",
    "pt": """o a os as de do da dos das e que em um uma para com não por no na nos nas se mais como mas foi ao ele ela sua seu ou
        ser quando muito há já está eu também só pelo pela até isso entre era depois sem mesmo aos nossa nosso são temos
        você vocês porque onde este esta essa esse ainda""",
    "nl": """de het een en van in is dat op te zijn met voor niet aan er om ook als door bij uit naar maar dan nog over wel we wij
        ons onze hij zij ze je u wat hoe waarom wordt werd worden heeft hebben kan kunnen meer deze dit die zo tot geen onder
        tegen want omdat""",
}
#: Scripts that tell a language, or a group of them, without words.
SCRIPTS = {
    "ru": r"\p{Cyrillic}", "el": r"\p{Greek}", "ar": r"\p{Arabic}", "he": r"\p{Hebrew}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}",
    "ko": r"\p{Hangul}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}",
}
#: Answers that hold no content (compared without case and outer signs).
PLACEHOLDERS = [
    "none", "null", "nil", "n/a", "na", "n.a", "tbd", "tba", "tbc", "nan", "unknown", "empty", "blank", "missing", "no answer",
    "no response", "not available", "not applicable", "no reply", "inaudible", "silence", "no audio", "no data", "to be determined",
]
#: Patterns of sentences that decline.
REFUSALS = [
    r"\b(?:not|never) (?:going to|able to|in a position to|prepared to|willing to) (?:get into|comment|discuss|disclose|share|speculate|answer|go into|provide|speak|break|talk|address|give|offer)\b",
    r"\b(?:don't|do not|won't|will not|can't|cannot|can not|couldn't|wouldn't|never) (?:\w+ ){0,2}?(?:comment|disclose|discuss|speculate|speak to|share|get into|go into|break (?:that|it|this|those|them) out|provide|answer|be answering|be commenting|be discussing|be sharing|give (?:that|those|any|you)|talk about|address|guide (?:on|to))\b",
    r"\b(?:would|'d|prefer) (?:rather |prefer )?(?:not|rather not|not to) (?:to )?(?:speculate|comment|answer|discuss|say|get into|go into|disclose|share|respond)\b",
    r"\brather not\b",
    r"\bdon't think it would be (?:helpful|appropriate|useful|productive|right)\b",
    r"\b(?:policy|practice) (?:is )?not to\b",
    r"\bhave nothing (?:\w+ )?to (?:share|add|say|report|announce|disclose)\b|\bnothing (?:more |further |else )?to (?:share|add|say|announce) (?:today|on that|at this)\b",
    r"\btake (?:that|this|it) (?:one )?off-?line\b",
    r"\b(?:isn't|is not|not) something (?:that )?we(?:'re| are| will|'ll| would)? (?:\w+ ){0,2}(?:break out|disclose|discuss|share|comment|provide|talk about|get into|give)\b",
    r"\bi'll (?:have to )?pass on\b|\bi will pass on\b|\bno comment\b|\b(?:must|have to|will|respectfully) decline\b|\bdecline to\b|\bdeclining to\b",
    r"\b(?:sorry|afraid|unfortunately|regret)\b.{0,30}\b(?:can't|cannot|can not|won't|not able|unable|not be)\b|\bunable to (?:comment|answer|discuss|share|provide|speak|disclose|say)\b",
    r"\bas an ai\b|\bi (?:can't|cannot|won't|am unable to|'m unable to) (?:help|assist|fulfil|fulfill)\b",
    r"\b(?:nicht|nichts|keine?n?|ungern)\b.{0,60}\b(?:äußern|sagen|kommentieren|kommentar|beantworten?|bekannt ?geben|nennen|mitteilen|auskunft|angaben|stellung nehmen|bekannt|eingehen|spekulieren|preisgeben|offenlegen)\b",
    r"\bgeben wir\b.{0,40}\bnicht (?:bekannt|heraus|preis)\b|\b(?:kein kommentar|keinen kommentar)\b|\blieber nicht\b",
    r"\b(?:ne|n['’])\s?\S*.{0,50}\b(?:commentaire|commenter|répondr\w*|communiqu\w+|divulgu\w+|détail\w*|dévoil\w+|préciser|précisons|spécul\w+|publions|donnons|dirai|dirons)\b",
    r"\bpréfér\w+ ne pas\b|\bpas de commentaires?\b|\baucun commentaire\b|\brien à ajouter\b",
    r"\b(?:no|nunca|tampoco)\b.{0,40}\b(?:comenta\w*|responde\w*|detalle\w*|divulga\w*|revela\w*|contesta\w*|especula\w*|facilita\w*|publica\w*|comentarios?|desglosa\w*|compart\w+|comunica\w*|entrar|dar)\b",
    r"\bprefier\w+ no\b|\bpreferir\w+ no\b|\bsin comentarios\b|\bnada que (?:añadir|comentar|decir)\b",
]
#: Sentences without substance that go with a refusal.
FILLERS = [
    r"^(?:yes|no|well|right|sure|okay|ok|look|so|yeah)?,?\s*(?:thanks|thank you)\b.{0,60}$",
    r"^(?:sure|right|okay|ok|well|yeah|yes|no|great question|good question|fair question|happy to|of course|correct)[.,!]*$",
    r"^(?:yeah, |sure, |okay, |well, |right, )?(?:let me (?:start|take that(?: one)?|begin)|i'll take that(?: one)?|happy to)[.!]*$",
    r"^next question,? please[.!]*$|^(?:let's|let us|we'll|we can|can we) (?:move on|go|take|have|turn)\b.{0,40}\b(?:caller|question|questioner|participant|next)\b.{0,20}$",
    r"^i (?:hope|trust|think) (?:that )?(?:you(?:'ll| will| can)?|everyone) (?:can )?(?:understand|appreciate).{0,40}$|^i appreciate (?:you|your|the).{0,40}$|^sorry\b.{0,30}$|^(?:i )?apolog.{0,40}$",
    r"^(?:we'd|we would|i'd|i would) rather (?:keep|stay|focus|leave).{0,60}$",
    r"^i (?:know|realise|realize|understand|appreciate) (?:that )?you(?:'d| would)? (?:like|want|love|need|prefer).{0,80}$",
    r"^there will be a (?:time|day|moment) for that.{0,40}$|^(?:maybe|perhaps) (?:another|some other) time.{0,20}$|^(?:ask|try) (?:me|us) again.{0,40}$|^(?:that's|that is) all (?:i|we) (?:can|will) say.{0,30}$",
    r"^(?:operator, )?(?:next|we'll leave it there|i'll leave it (?:there|at that)|let's leave it (?:there|at that))[.!]*$",
    r"^(?:vielen )?dank\b.{0,40}$|^(?:die )?nächste frage.{0,20}$|^(?:ich )?bitte (?:um|haben sie) .{0,30}verständnis.{0,20}$|^tut mir leid.{0,20}$",
    r"^merci\b.{0,60}$|^(?:la )?question suivante.{0,30}$|^passons à la .{0,30}$|^désolée?.{0,20}$|^j'espère que vous.{0,30}$",
    r"^(?:muchas )?gracias\b.{0,50}$|^(?:la )?siguiente pregunta.{0,30}$|^pasemos a la .{0,30}$|^lo siento.{0,20}$|^espero que (?:lo )?(?:entienda|comprenda).{0,20}$",
]
#: A sentence that declines a part and goes on to answer.
CONTRAST = r"\bbut\b|\bhowever\b|;|\bhere is\b|\bhere's\b|\blet me give\b|\bso let me\b|\bthat said\b|\bwhat i can\b|\bi can (?:tell|say|give)\b|\bthough\b(?!\.)|\baber\b|\bjedoch\b|\bmais\b|\bcependant\b|\bpero\b|\bsin embargo\b"
#: A copy: what is left of the response with the prompt as dictionary, as a share of what it has without and in
#: bytes (more where it is long); what is left of the prompt with the response; and how much longer it is in words.
COPY_LEFT, COPY_BYTES, COPY_BACK, COPY_LONGER = 0.5, 40, 0.5, 1.35
#: Share of its distinct words that a copy has from the prompt; below that it needn't be compressed.
COPY_SHARED = 0.5
#: Bits of the filter that tells the counting pass which contexts are asked for.
FILTER_BITS = 1 << 23

_BRACKETS = re.compile(r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|\*[^*]*\*")
_BRACKET = re.compile(r"[\[(<*]")
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”’»)\]]*\s+")
_OUTER = regex.compile(r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$")
_CLOSERS = re.compile(r"(?:\[[^\]]*\]|\([^()]*\)|[\s\"”’»“„«*_)\]])+$")
_TERMINAL = re.compile(r"[.!?。！？:;]$")
_ELLIPSIS = re.compile(r"(?:…|\.\s?\.\s?\.)$")
_NUMBER = re.compile(r"\d(?:[\d.,]*\d)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[$€£]?\d[\d.,]*\d|[$€£]?\d|%|[^\s\w]|_")


def words_of(text: str) -> list[str]:
    return _WORDS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def compressed(text: bytes, known: bytes = b"") -> int:
    """Bytes of a text by zstandard, with another one as dictionary."""
    p = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(text), dict_size=len(known), write_content_size=False, write_dict_id=False)
    d = {"dict_data": zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if known else {}
    return len(zstandard.ZstdCompressor(compression_params=p, **d).compress(text))


class Rules:
    """Compiled dictionaries; built once in each task."""

    def __init__(self, stop_words: dict[str, str], refusals: list[str], placeholders: list[str]):
        lists = {k: set(v.split()) for k, v in stop_words.items()}
        shared = Counter(w for v in lists.values() for w in v)
        #: A word of several languages counts in part for each.
        self.languages = list(lists)
        self.votes = {w: [(k, 1 / n) for k, v in lists.items() if w in v] for w, n in shared.items()}
        self.refusal = [regex.compile(p, regex.I) for p in refusals]
        #: Whether any sentence may decline: one search over the whole response.
        self.declines = regex.compile("|".join(f"(?:{p})" for p in refusals), regex.I)
        self.filler = [re.compile(p, re.I) for p in FILLERS]
        self.contrast = re.compile(CONTRAST, re.I)
        self.placeholder = set(placeholders)
        self.longest = max((len(words_of(p)) for p in placeholders), default=0)
        self.scripts = [(k, regex.compile(p)) for k, p in SCRIPTS.items()]

    def empty(self, bare: str, ws: list[str]) -> bool:
        """Whether a response without annotations, of words ws, has no content."""
        if len(ws) > self.longest:
            return False
        text = " ".join(_OUTER.sub("", bare).lower().split())
        return not text or text in self.placeholder

    def language(self, text: str, ws: list[str]) -> tuple[str | None, float]:
        """The language with clearly most function words, or by its script, and their weight."""
        if not text.isascii():
            for k, p in self.scripts:
                if 2 * len(p.findall(text)) > sum(map(str.isalpha, text)):
                    return k, float(len(ws))
        total: dict[str, float] = {}
        for votes in filter(None, map(self.votes.get, ws)):
            for k, x in votes:
                total[k] = total.get(k, 0.0) + x
        n = sorted(((x, k) for k, x in total.items()), reverse=True)
        first, second = (n[0] if n else (0.0, None)), (n[1][0] if len(n) > 1 else 0.0)
        if first[0] < 2 or first[0] < 1.5 * second or first[0] < 0.12 * len(ws):
            return None, first[0]
        return first[1], first[0]

    def copied(self, qw: list[str], aw: list[str], cut: bool) -> bool:
        """Whether a response is its prompt again, by how little each adds to the other; cut: it ends in an ellipsis."""
        if len(qw) < 4 or len(aw) < 4 or len(aw) > COPY_LONGER * len(qw):
            return False
        mine = set(aw)
        if len(mine.intersection(qw)) < COPY_SHARED * len(mine):
            return False
        if cut:  # a shortened copy can only hold the beginning
            qw = qw[: len(aw) + 2]
        q, a = " ".join(qw).encode(), " ".join(aw).encode()
        left = compressed(a, q)
        if left > COPY_BYTES + max(0, len(a) - 400) / 25 or left > COPY_LEFT * compressed(a):
            return False
        return compressed(q, a) <= COPY_BACK * compressed(q)

    def refuses(self, a: str) -> bool:
        """Declines and says nothing else."""
        a = " ".join(_BRACKETS.sub(" ", a).replace("’", "'").split())
        if not self.declines.search(a):
            return False
        sentences = [s.strip(" \"“”*_>") for s in _SENTENCE.split(a)]
        declined = False
        for s in sentences:
            if not s or any(p.search(s) for p in self.filler):
                continue
            if self.contrast.search(s) or not any(p.search(s) for p in self.refusal):
                return False
            if _ELLIPSIS.search(s):
                return False
            declined = True
        return declined


def tail_of(a: str) -> str:
    """The response without closing quotes, brackets, annotations and space."""
    while (b := _CLOSERS.sub("", a)) != a:
        a = b
    return a


def contexts(text: str) -> list[tuple[str, str]]:
    """(last token but one, last token) before each position of a text, numbers masked."""
    ts = _TOKEN.findall(_NUMBER.sub("9", text.lower()))
    return list(zip(["", *ts], ts))


class ContextCounter:
    """Counts of contexts, final and in all, of those that a filter lets through."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.known: dict[str, bool] = {}

    def asked(self, ctx: str) -> bool:
        ok = self.known.get(ctx)
        if ok is None:
            h = xxhash.xxh64_intdigest(ctx, seed=42) % (8 * len(self.bits))
            ok = bool(self.bits[h >> 3] >> (h & 7) & 1)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[ctx] = ok
        return ok

    def count(self, text: str, into: Counter) -> None:
        sentences = _SENTENCE.split(text)
        known, asked = self.known, self.asked
        for k, s in enumerate(sentences):
            ctx = contexts(s)
            end = len(ctx)
            while end and ctx[end - 1][1] in ".!?。！？":
                end -= 1
            last = end - 1
            if k == len(sentences) - 1:
                end -= 1  # the ending itself is what is in question
            for i in range(end):
                a, b = ctx[i]
                ok = known.get(b)
                if ok or ok is None and asked(b):
                    into[b, i == last] += 1
                    if asked(two := f"{a} {b}"):
                        into[two, i == last] += 1


def _judge(rules: Rules, q: str | None, a: str | None) -> tuple[str | None, str | None, str | None]:
    """(defect, two-word context, one-word context); contexts only where the model must decide."""
    bare = _BRACKETS.sub(" ", a or "") if _BRACKET.search(a or "") else a or ""
    aw = words_of(bare)
    if rules.empty(bare, aw):
        return "empty_answer", None, None
    if q:
        cut = bool(_ELLIPSIS.search(bare.rstrip()))
        qw = words_of(q)
        if rules.copied(qw, aw, cut):
            return "copied_question", None, None
        ql, _ = rules.language(q, qw)
        al, n = rules.language(bare, aw)
        if ql and al and ql != al and n >= 2:
            return "other_language", None, None
    if rules.refuses(a):
        return "refusal", None, None
    end = tail_of(a)
    if not end or _ELLIPSIS.search(end) or _TERMINAL.search(end) and not end.endswith((":", ";")):
        return None, None, None
    ctx = contexts(end)
    if not ctx:
        return None, None, None
    return None, " ".join(ctx[-1]), ctx[-1][1]


def broken_pairs(
    df: DataFrame,
    *,
    pair_id: str,
    prompt: str,
    response: str,
    stop_words: dict[str, str] = STOP_WORDS,
    refusals: list[str] = REFUSALS,
    placeholders: list[str] = PLACEHOLDERS,
    complete_from: float = 0.5,
) -> DataFrame:
    """(pair_id, defect) of each defective pair.

    Null, empty, blank and placeholder responses are empty_answer. A null or empty prompt
    can be neither copied nor differ in language. A response that ends in an ellipsis is
    shortened, not broken off. Rows delivered twice come out once; a null pair id is
    kept; an empty table gives an empty result; other columns are ignored. Whole texts
    are read.
    """
    kind = dict(df.dtypes)[pair_id]
    rows = df.select(F.col(pair_id), F.col(prompt), F.col(response))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(stop_words, refusals, placeholders)
        for b in batches:
            out = [_judge(rules, q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = [i for i, o in enumerate(out) if any(o)]
            cols = [pa.array([out[i][c] for i in keep], pa.string()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), *cols], names=[pair_id, "defect", "two", "one"])

    judged = checkpoint(rows.mapInArrow(judge, f"`{pair_id}` {kind}, defect string, two string, one string").distinct())
    open_ = judged.where("defect is null")
    asked = open_.select(F.explode(F.array("two", "one")).alias("ctx")).distinct()
    # which contexts are asked for goes to the tasks as a filter of a fixed size; the join makes it exact
    place = F.pmod(F.xxhash64("ctx"), F.lit(FILTER_BITS)) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    size = 4096
    bits = bytearray(FILTER_BITS // 8)
    for r in maps:
        bits[(r["b"] - 1) * size : r["b"] * size] = r["m"]
    sent = df.sparkSession.sparkContext.broadcast(bytes(bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ContextCounter(sent.value)
        for b in batches:
            into: Counter = Counter()
            for a in b.column(0).to_pylist():
                if a:
                    counter.count(a, into)
            keys = list(into)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([into[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([into[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["ctx", "final", "total"])

    model = rows.select(response).mapInArrow(count, "ctx string, final long, total long").join(asked, "ctx", "left_semi")
    model = checkpoint(model.groupBy("ctx").agg(F.sum("final").alias("final"), F.sum("total").alias("total")))
    for c in ("two", "one"):
        open_ = salted_join(open_, model.select(F.col("ctx").alias(c), (F.col("final") / F.col("total")).alias(f"p_{c}"), F.col("total").alias(f"n_{c}")), [c], how="left")
    complete = F.when(F.col("n_two") >= 3, F.col("p_two")).otherwise(F.coalesce("p_one", F.lit(0.0)))
    broken = open_.where(complete < complete_from).select(pair_id, F.lit("truncated_answer").alias("defect"))
    return judged.where("defect is not null").select(pair_id, "defect").unionByName(broken).distinct()
