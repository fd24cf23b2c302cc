"""Problem 2: defective instruction and output pairs.

Every labelling function votes on its own: none looks at what another says or at
another defect.  Several are weak on purpose (length, vocabulary, first person):
alone they mean nothing, and the label model finds out how far to trust them.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import bounded, staged

DEFECTS = ("empty", "copied", "refusal", "wrong_language", "truncated")
#: Posteriors that a kept label exceeds: the best of twenty steps on planted defects, of equal ones the nearest to a half
#: (validated_cutoffs on the tables at 0.01 and 0.1 gives these).
CUTOFFS = {"empty": 0.5, "copied": 0.5, "refusal": 0.5, "wrong_language": 0.5, "truncated": 0.5}
#: A parameter belongs to an action if so large a share of its last steps has it.
USUAL = 0.9
#: A vote: 1 defect, 0 no defect, 2 abstains.
YES, NO, NONE = 1, 0, 2

# Function words by language, openings and phrases of refusals, placeholders, framings.
FUNCTION_WORDS = {
    "en": "the and to of for on in with is are that this after before so when while from by at each as only not between than more which because until ahead without need we you please help must can could us what has have it its be will was were since users owners reports lists asked",
    "de": "der die das und zu von für auf in mit ist sind dass dieser diese nach vor damit wenn während aus bei jede als nur nicht zwischen mehr weil bis ohne wir sie bitte muss kann könnte uns was hat haben es wird wurde den dem des ein eine einer einem einen um im am zum zur auch noch jemand heute nutzer steht bleiben sonst zwei wie vereinbart bevor werden",
    "es": "el la los las y de para en con es son que este esta después antes cuando mientras desde por cada como solo no entre más porque hasta sin nosotros usted favor debe puede nos qué ha han lo su sus un una al del se hoy tenemos quiero hay fue sobre queda tras usuarios está según puedan alguien debemos hemos",
    "fr": "le la les et de pour sur dans avec est sont que ce cette après avant quand pendant depuis par chaque comme seulement ne pas entre plus parce jusqu sans nous vous merci doit peut qu a ont il elle son ses un une au aux du des se aujourd hui devons faut été reste afin utilisateurs car reçu l d n s c responsables équipe quelqu tous",
}
_LANG = {w: [k for k, v in FUNCTION_WORDS.items() if w in v.split()] for v in FUNCTION_WORDS.values() for w in v.split()}
OPENINGS = re.compile(
    r"^\W*(?:hmm\W+)?(?:(?:i'?m |i am |we are |so )?(?:very |really )?sorry|apolog\w+|i apologi[sz]e|unfortunately|regrettably|i regret|i'?m afraid|as an (?:ai|assistant|ai assistant|language model)|thanks? (?:you )?for asking\W+(?:however|but)|i have to be honest"
    r"|lo siento|lamento|lamentablemente|desafortunadamente|por desgracia|disculp\w+|perdon\w*|como asistente|gracias por (?:preguntar|la pregunta)\W+pero"
    r"|es tut mir|tut mir leid|leider|bedaure\w*|entschuldig\w+|als (?:ki\W?)?assistent|danke f[uü]r die (?:frage|anfrage)\W+(?:aber|doch)"
    r"|je suis d[eé]sol[eé]e?|d[eé]sol[eé]e?|malheureusement|je regrette|en tant qu\W?assistant|pardon|merci de (?:votre|la) (?:question|demande)\W+mais)",
    re.I,
)
PHRASES = re.compile(
    r"\b(?:i|we) (?:can(?:no|')?t|cannot|won'?t|will not|must decline|have to decline|am not able|'?m not able|do not feel comfortable|don'?t feel comfortable|have no permission|am unable|refuse)|\bi'?m (?:unable|not able|not permitted|not allowed)|unable to (?:comply|help|assist|answer)|must decline|request will not be fulfilled|beyond what i may|no configuration can be given|something i won'?t|can'?t help with|not able to do this|(?:forbidden|not permitted|not allowed|prohibited) (?:to|from)"
    r"|no puedo (?:ayudar|hacer|responder|dar|ofrecer|atender|cumplir)|no voy a (?:hacer|responder|dar)|no me est[aá] permitido|no debo|no es posible (?:ayudar|responder)|tengo que (?:negarme|rechazar)|debo (?:negarme|rechazar)|no tengo permiso|no (?:har[eé]|quiero|lo)\b|prohibido"
    r"|kann ich (?:leider )?nicht (?:helfen|beantworten|tun)|darf ich (?:diese anfrage )?nicht|nicht (?:helfen|beantworten|erlaubt)|muss ich ablehnen|werde ich nicht|keine konfiguration (?:geben|liefern)|lehne ich ab|ich (?:werde|kann|darf|m[oö]chte|will)\b[^.]{0,40}\bnicht\b|mache ich nicht|(?:werde|kann|darf|m[oö]chte|will) ich\b[^.]{0,40}\bnicht\b|mir (?:ist|wurde) (?:das |dies |es )?(?:untersagt|verboten|nicht)|untersagt"
    r"|je ne (?:peux|puis|vais|suis) pas|je dois (?:refuser|d[eé]cliner)|ne (?:peux|puis) pas (?:aider|r[eé]pondre)|je refuse|je ne \w+ (?:pas|rien)\b|il m'est (?:impossible|interdit|d[eé]fendu)|pas autoris[eé]",
    re.I,
)
AFTERWORDS = re.compile(
    r"is there anything else|i hope you understand|try another question|please ask a specialist|contact whoever runs|my guidelines|might be unsafe|request closed"
    r"|otra pregunta|pregunte a quien|espero que (?:lo )?(?:entienda|comprenda)|hay algo m[aá]s|mis (?:normas|reglas)|andere frage|fragen sie|verst[aä]ndnis|kann ich sonst|meine (?:regeln|richtlinien)|autre question|adressez-vous|j'esp[eè]re que vous|puis-je|mes (?:r[eè]gles|consignes)",
    re.I,
)
#: Words of which every phrase (afterword) has one: texts without them needn't be searched.
PHRASE_WORDS = frozenset("i we unable decline fulfilled given help able forbidden permitted allowed prohibited no tengo debo prohibido ich nicht ablehnen keine mir untersagt je ne il pas".split())
AFTER_WORDS = frozenset("else understand question specialist contact guidelines unsafe closed pregunta pregunte entienda comprenda algo normas reglas frage fragen verständnis verstandnis sonst regeln richtlinien autre adressez espère espere puis règles regles consignes".split())
PLACEHOLDERS = {"todo", "tbd", "tba", "fixme", "null", "none", "nil", "nan", "n a", "na", "no output", "empty", "placeholder", "nothing", "undefined", "no answer", "no response", "output", "answer", "blank", "missing", "leer", "vacio", "vide", "keine", "ninguno", "aucun", "yaml", "json", "text", "to do", "to be done", "to be defined", "pending", "wip", "sin salida", "keine ausgabe"}
_FRAME_HEAD = re.compile(r"^\W*(?:(?:q|a|question|answer|request|instruction|prompt|input|output|response|reply|task|user|assistant|description|note|frage|antwort|anfrage|auftrag|pregunta|respuesta|solicitud|demande|réponse|requête|your (?:question|request|instruction) (?:was|is)|you (?:asked|said|wrote)|you asked me|ihre (?:frage|anfrage) (?:war|lautete)|su (?:pregunta|solicitud) (?:era|fue)|votre (?:question|demande) (?:était|etait))\s*[:=\-–—]\s*)+", re.I)
_MARKS = re.compile(r"^[\s>#*\"'“”‘’`(\[]+")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^\s*```[^\n]*$", re.M)
_TOP = re.compile(r"^(version|metadata|steps|validation|rollback|error)\s*:", re.M)
_DESCRIPTION = re.compile(r"^\s*(?:- )?(?:description|reason|suggestion)\s*:\s*(.+)$", re.M)
_ENTRY = re.compile(r"^(\s*)(- )?([A-Za-z_][\w.-]*)?(\s*:)?\s*(.*)$")


def compact(text: str) -> str:
    """Letters and digits only, without case and accents."""
    flat = unicodedata.normalize("NFKD", text.casefold())
    return "".join(_ALNUM.findall("".join(c for c in flat if not unicodedata.combining(c)))) if not text.isascii() else "".join(_ALNUM.findall(flat))


def language(words: list[str]) -> tuple[str, int, int]:
    """(language, its function words, those of the next) of lower-cased words: by exclusive and shared function words."""
    score = dict.fromkeys(FUNCTION_WORDS, 0)
    for w, times in Counter(words).items():
        own = _LANG.get(w)
        if own:
            for k in own:
                score[k] += times * (3 if len(own) == 1 else 1)
    ranked = sorted(score.items(), key=lambda x: -x[1])
    return ranked[0][0], ranked[0][1], ranked[1][1]


def likeness(a: str, b: str) -> float:
    """Jaccard share of the character quadruples of two compact texts."""
    x, y = {a[i : i + 4] for i in range(len(a) - 3)}, {b[i : i + 4] for i in range(len(b) - 3)}
    return len(x & y) / max(1, len(x | y))


def structure(text: str) -> tuple[bool, bool, str, str]:
    """Of a configuration: (last entry unfinished, whole parts missing, action of the last step, its parameters)."""
    lines = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith(("```", "#"))]
    if not lines:
        return False, False, "", ""
    tops = set(m.group(1) for m in _TOP.finditer(text))
    last = lines[-1]
    bare = last.strip()
    _, dash, key, colon, value = _ENTRY.match(last).groups()
    unfinished = False
    if key and colon and not value.strip():
        unfinished = True  # a key without value or children
    elif key and not colon and not dash:
        unfinished = True  # a key cut before its colon
    elif dash and (not key and not value or not colon and key in ("id", "type", "action", "name", "target", "i", "ty", "typ")):
        unfinished = True
    v = value.strip() if colon else bare[2:].strip() if dash else bare
    if v[:1] in "\"'" and v and (len(v) < 2 or v[-1] != v[0] or v.endswith('\\"')):
        unfinished = True
    if v[:1] == "[" and not v.endswith("]") or v[:1] == "{" and not v.endswith("}"):
        unfinished = True
    missing = "steps" not in tops or "version" not in tops and "metadata" not in tops
    has_item = bool(re.search(r"^\s*- id\s*:", text, re.M))
    if not has_item and not ("error" in tops and re.search(r"^\s+(reason|is_error)\s*:", text, re.M)):
        missing = True
    if not has_item and "error" in tops and not re.search(r"^\s+reason\s*:\s*\S", text, re.M):
        missing = True
    # the last mapping entry of a list: a step or a check
    at = next((i for i in range(len(lines) - 1, -1, -1) if re.match(r"\s*- [A-Za-z_]+\s*:", lines[i])), None)
    action = params = ""
    if at is not None:
        ind = len(lines[at]) - len(lines[at].lstrip())
        keys, inner, head, deep = [], [], "", ind + 2
        closed = False
        for x in lines[at:]:
            own = len(x) - len(x.lstrip())
            if own < ind or own == ind and x is not lines[at] and not x.lstrip().startswith("- "):
                closed = True
                break
            m = re.match(r"\s*(?:- )?([A-Za-z_]\w*)\s*:?\s*(.*)$", x)
            if not m:
                continue
            if x is lines[at] or own == deep:
                keys.append(m.group(1))
                head = m.group(1)
                if m.group(1) == "action":
                    action = m.group(2).strip().strip("\"'")
            elif head == "params" and own == deep + 2:
                inner.append(m.group(1))
        if keys and keys[0] == "id":
            if len(set(keys)) < 4 and not {"action", "description", "params"} <= set(keys) or ("params" in keys and not inner and not closed):
                missing = True
            params = " ".join(inner)
            if not closed and not action:
                unfinished = True
        elif keys == ["type"]:
            missing = True
        if keys and keys[0] != "id":
            action = ""
    return unfinished, missing, action, params


FIRST_PERSON = set("i we my our us me i'm ich wir mir uns mein meine yo nosotros mi mis nos puedo tengo debo je nous mon mes moi".split())
#: Letters that speak for a language.
LETTERS = {c: k for k, v in {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "çœèêëîïôûàù"}.items() for c in v + v.upper()}
_SPECIAL = re.compile("[" + "".join(LETTERS) + "]")
ANSWERS_TO = {"empty": 5, "copied": 5, "refusal": 6, "wrong_language": 4, "truncated": 6}


def letters_of(text: str) -> str:
    """The language that most of a text's special letters speak for, or none."""
    if text.isascii():
        return ""
    found = Counter(LETTERS[c] for c in _SPECIAL.findall(text)).most_common(2)
    return found[0][0] if found and (len(found) == 1 or found[0][1] > found[1][1]) else ""


def tri(yes: bool, no: bool) -> int:
    return YES if yes else NO if no else NONE


def votes(instruction: str | None, output: str | None) -> tuple[list[list[int]], str, str]:
    """Votes of all labelling functions, by defect; action and parameters of a configuration's last step."""
    text, asked = output or "", instruction or ""
    body = text.strip().strip(" \ufeff\u200b").strip()
    inner = _FENCE.sub("", body).strip()
    config = len(_TOP.findall(inner)) >= 2 or bool(re.match(r"\W*version\s*:\s*\S", inner))
    words = _ALNUM.findall(inner.lower())
    own = _ALNUM.findall(asked.lower())
    n = len(words)
    bare = inner if config else _FRAME_HEAD.sub("", _MARKS.sub("", inner)).strip()
    none = [NONE] * 6

    # nothing there, a placeholder, keys without values, very few words, few beside the request
    hollow = not inner or n <= 12 and all(not x.partition(":")[2].strip(" \"'[]{}~|>-") and ":" in x for x in inner.split("\n") if x.strip())
    empty = [tri(n == 0, True), tri(n == 0 or " ".join(words) in PLACEHOLDERS, True), tri(hollow and n <= 6, not hollow), tri(n <= 2, n >= 8), tri(10 * n < len(own), 3 * n >= len(own))]
    if n == 0 or hollow and n <= 6:
        return [empty, none[:5], none, none[:4], none], "", ""

    # equal but for spelling, alike in letters, nothing but repetitions, holding the request whole, of its words; a
    # configuration has keys that no request has, and is not compared
    copied = [NO, NO, NO, NONE, NONE] if config else none[:5]
    a = "" if config else compact(asked)
    asked_words = set(own)
    if len(a) >= 8:
        b, c = compact(bare), compact(inner)
        near = likeness(a, b) if len(b) < 3.5 * len(a) + 60 else 0.0
        rest = c.replace(a, "")
        shared = sum(w in asked_words for w in words) / n
        copied = [tri(b == a or c == a, True), tri(near >= 0.8, near < 0.5), tri(c != rest and len(rest) <= 30 and len(rest) < len(a), True), tri(a in c, True), tri(shared >= 0.9, shared < 0.6)]

    # how it begins, what it says, how it takes leave, who speaks, what it takes up, whether it is a configuration (of
    # which only descriptions and reasons are read)
    told = " ".join(_DESCRIPTION.findall(inner)) if config else inner
    plain = (told if config else bare).replace("\u2019", "'").replace("`", "'")
    said = _WORD.findall(told.lower()) if config else words
    heard = set(said)
    speaks = sum(w in FIRST_PERSON for w in said)
    taken = sum(len(w) > 5 for w in asked_words.intersection(words))
    wordy = n > max(60, 2 * len(own))
    phrase = not heard.isdisjoint(PHRASE_WORDS) and bool(PHRASES.search(plain))
    after = not heard.isdisjoint(AFTER_WORDS) and bool(AFTERWORDS.search(plain))
    refusal = [tri(bool(OPENINGS.match(plain)), True), tri(phrase and not wordy, not phrase), tri(after, wordy), tri(speaks > 0 and 12 * speaks >= len(said), speaks == 0), tri(taken == 0 and n < 60, taken >= 2), tri(False, config)]

    # function words of another language, clearly, on both sides in number, its letters
    li, si, ti = language(own)
    lo, so, to = language(said)
    sure = si - ti >= 3 and so - to >= 3
    mine, theirs = letters_of(asked), letters_of(told)
    wrong = [tri(sure and li != lo, sure), tri(sure and li != lo and so >= 1.5 * to, sure and li == lo), tri(li != lo and so >= 6 and si >= 6 and sure, li == lo and sure), tri(bool(theirs) and theirs != li and theirs != mine and sure, bool(theirs) and theirs == li)]

    # an open fence, an unfinished last entry or sentence, missing parts or a last word that asks for another, parameters (see below), few lines, no whole by any sign
    marks = body.count("```")
    action = params = ""
    last = words[-1]
    if config:
        unfinished, missing, action, params = structure(inner.rstrip())
        lines = inner.count("\n") + 1
        cut = [tri(marks % 2 == 1, marks > 0), tri(unfinished, True), tri(missing, True), NONE, tri(lines <= 5, lines >= 12)]
    else:
        end = re.sub(r"[\s\"'”’»)\]`*_]+$", "", inner)[-1:]
        stop = not end or end in ".!?…。"
        cut = [tri(marks % 2 == 1, marks > 0), tri(not stop, True), tri(last in _LANG and not stop, stop), NONE, tri(n <= 4, n >= 12)]
    tail = inner[-200:]
    broken = any(tail.count(a) > tail.count(b) + k for a, b, k in (("(", ")", 1), ("[", "]", 0), ("{", "}", 0)))
    cut.append(tri(broken or marks % 2 == 1 or (unfinished or missing if config else not stop), True))
    return [empty, copied, refusal, wrong, cut], action, params


N_VOTES = tuple(ANSWERS_TO.values())
#: Weight of the fourth vote on broken-off outputs, which is cast when all rows are known.
PARAMS_VOTE = 3 ** (N_VOTES[4] - 4)


def pattern(v: list[int]) -> int:
    """Votes as one number to the base of three."""
    out = 0
    for x in v:
        out = out * 3 + x
    return out


class LabelModel:
    """For each function the chance of a yes, where it votes, given the defect (good) and given none (bad), and the share of the defect.

    An abstention says nothing either way.
    """

    FIRST_GOOD, FIRST_BAD = 0.8, 0.03

    def __init__(self, n: int, prior: float = 0.01):
        self.n, self.p = n, prior
        self.good, self.bad = np.full(n, self.FIRST_GOOD), np.full(n, self.FIRST_BAD)

    def _digits(self, patterns: np.ndarray) -> np.ndarray:
        return np.stack([(patterns // 3 ** (self.n - 1 - k)) % 3 for k in range(self.n)], axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.full(len(patterns), np.log(self.p) - np.log(1 - self.p))
        for k, own in enumerate(self._digits(patterns).T):
            odds += np.where(own == YES, np.log(self.good[k] / self.bad[k]), np.where(own == NO, np.log((1 - self.good[k]) / (1 - self.bad[k])), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        """Expectation-maximization over counted vote patterns.

        The chances begin at functions that mostly tell the truth and are
        estimated anew from all rows in every round; a function that would turn
        against its meaning is held back to no better than chance.
        """
        digits, total = self._digits(patterns), counts.sum()
        for _ in range(rounds):
            q = self.posterior(patterns)
            w, u = q * counts, (1 - q) * counts
            self.p = float(np.clip((w.sum() + 1) / (total + 100), 1e-4, 0.2))
            for k in range(self.n):
                yes, no = digits[:, k] == YES, digits[:, k] == NO
                good = (w[yes].sum() + 4 * self.FIRST_GOOD) / (w[yes].sum() + w[no].sum() + 4)
                bad = (u[yes].sum() + 4 * self.FIRST_BAD) / (u[yes].sum() + u[no].sum() + 4)
                self.good[k], self.bad[k] = (good, bad) if good > bad else ((good + bad) / 2,) * 2
        return self


VOTES = "row_id bigint, " + ", ".join(f"v_{d} int" for d in DEFECTS) + ", action string, params string"


def cast_votes(records: DataFrame, id_col: str = "row_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """row_id and the vote pattern on each defect (v_<defect>), a row per record, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [votes(i, o) for i, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [batch.column(0), *[pa.array([pattern(r[0][k]) for r in rows], pa.int32()) for k in range(5)], pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in VOTES.split(", ")])

    texts = records.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(instruction).alias("i"), F.col(output).alias("o")).filter("row_id is not null")
    voted = staged(texts.mapInArrow(run, VOTES), "votes")
    steps = voted.filter("action <> ''")
    size = steps.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    each = steps.select("action", F.explode(F.split("params", " ")).alias("param")).filter("param <> ''").groupBy("action", "param").agg(F.count(F.lit(1)).alias("m"))
    usual = each.join(size, "action").filter(F.col("m") >= USUAL * F.col("n")).groupBy("action").agg(F.collect_set("param").alias("usual"))
    # a misspelt parameter still counts as one: fewer than usual have to be there
    lacking = (F.size(F.split("params", " ")) < F.size("usual")) & (F.size(F.array_except(F.coalesce("usual", F.array().cast("array<string>")), F.split("params", " "))) > 0)
    vote = F.when(F.col("action") == "", NONE).when(lacking, YES).otherwise(NO)
    known = voted.join(bounded(usual, 10_000), "action", "left").withColumn("v_truncated", F.col("v_truncated") - (NONE - vote) * PARAMS_VOTE)
    return staged(known.drop("usual", "action", "params"), "all-votes")


def label_models(voted: DataFrame) -> tuple[dict[str, LabelModel], dict[str, np.ndarray]]:
    """A label model for each defect, and the vote patterns that occur (at most 3^6 a defect, whatever the table's size)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"v_{d}").alias("v")) for d in DEFECTS]))
    seen: dict[str, list[tuple[int, int]]] = {d: [] for d in DEFECTS}
    for r in voted.select(pairs.alias("x")).groupBy("x.d", "x.v").agg(F.count(F.lit(1)).alias("n")).collect():
        seen[r["d"]].append((r["v"], r["n"]))
    models, patterns = {}, {}
    for d, own in seen.items():
        patterns[d] = np.array([v for v, _ in own], dtype=np.int64)
        models[d] = LabelModel(ANSWERS_TO[d]).fit(patterns[d], np.array([n for _, n in own], dtype=float)) if own else LabelModel(ANSWERS_TO[d])
    return models, patterns


def defect_posteriors(records: DataFrame, id_col: str = "row_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """row_id and the posterior of each defect (columns named after them), a row per record.

    Method: labelling functions vote on every row for every defect, each by
    itself; rows with equal votes are counted together, an
    expectation-maximization label model turns the counts into the functions'
    accuracies and the patterns' posteriors, and these are joined back.  Whether
    the last step of a configuration lacks parameters is judged by what the steps
    of the same action have in all rows.

    Null outputs are empty; without an instruction nothing can be copied or in
    another language.  Rows with a null id are left out.
    """
    better = cast_votes(records, id_col, instruction, output)
    models, patterns = label_models(better)
    for d in DEFECTS:
        rows = [(int(c), float(x)) for c, x in zip(patterns[d], models[d].posterior(patterns[d]))] if len(patterns[d]) else []
        known = records.sparkSession.createDataFrame(rows, f"v_{d} int, {d} double")
        better = better.join(F.broadcast(known), f"v_{d}")
    return better.select("row_id", *DEFECTS)


def defect_labels(posteriors: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """row_id, defects (every label whose posterior exceeds its cutoff), a row per flagged record.

    A record may have several.  They stand in the order of DEFECTS: an empty or
    copied output has no other answer in it, a refusal's language matters less
    than the refusal.
    """
    cut = {**CUTOFFS, **(cutoffs or {})}
    kept = F.array_compact(F.array(*[F.when(F.col(d) > cut[d], F.lit(d)) for d in DEFECTS]))
    return posteriors.select("row_id", kept.alias("defects")).filter(F.size("defects") > 0)


def single_defects(posteriors: DataFrame) -> DataFrame:
    """row_id, defect: the first label of each flagged record, the form that problem 2 asks for."""
    return defect_labels(posteriors).select("row_id", F.col("defects")[0].alias("defect"))


# What is planted to validate cutoffs; the second list of refusals has no phrase that a function knows.
PLANTED_EMPTY = ("", " \n ", "TODO", "...", "```yaml\n```", "n/a", "output:", "{}", "<pending>", "steps:\nmetadata:")
PLANTED_REFUSAL = (
    "Sorry, that is one I have to leave alone.", "I'm afraid my answer to this is no.", "Unfortunately I can't help with that request.", "This is nothing I will do. Please try another question.",
    "Lo siento, pero no voy a hacer esto.", "Leider kann ich bei dieser Anfrage nicht helfen.", "Je regrette, mais je ne peux pas répondre à cela.", "We would rather not take this on, I hope you understand.",
)
UNLISTED_REFUSAL = (
    "That is outside what I take on.", "You will have to ask somebody else for this one.", "My answer is no.", "This one stays undone.",
    "Eso queda fuera de mi alcance.", "Das übersteigt meine Aufgaben.", "Cela dépasse mon rôle.", "Not going to happen.",
)
COPY_FRAMES = ("{0}", "{0}\n\n{0}", "Request: {0}", "> {0}", "You asked: {0}", '"{0}"')


def planted(rows: list[tuple[str, str]], seed: int = 3) -> list[tuple[str, str, str]]:
    """(defect, instruction, output): each sound pair once with every defect, as far as it can be given to it."""
    rnd = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for _, o in rows:
        if not _TOP.search(o):
            by_lang.setdefault(language(_WORD.findall(o.lower()))[0], []).append(o)
    out = []
    for i, o in rows:
        out += [("empty", i, rnd.choice(PLANTED_EMPTY)), ("copied", i, rnd.choice(COPY_FRAMES).format(i.upper() if rnd.random() < 0.2 else i)), ("refusal", i, rnd.choice(PLANTED_REFUSAL))]
        others = [k for k in by_lang if k != language(_WORD.findall(i.lower()))[0]]
        if others:
            out.append(("wrong_language", i, rnd.choice(by_lang[rnd.choice(others)])))
        at = rnd.randint(len(o) // 5, max(len(o) // 5, len(o) - 2))
        part = o[:at].rstrip()
        if part and part[-1] not in ".!?\"'`" and "\n" in part or len(part) > 40 and part[-1].isalnum():
            out.append(("truncated", i, part))
    return out


def validated_cutoffs(records: DataFrame, sample: int = 2_000, seed: int = 3) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Cutoffs that do best on planted defects, and (recall, false alarms among sound rows) of each on the other half.

    The label models are those of the whole table.  A bounded sample of pairs
    that no model suspects (``sample`` rows, the first by hash) gets every defect
    planted; one half chooses, for each defect, the cutoff of highest F1, the
    other half measures it.  CUTOFFS are such cutoffs.  ``unlisted`` measures
    refusals in words that no function knows, at the cutoff of refusals.
    """
    voted = cast_votes(records)
    models, _ = label_models(voted)
    clean = defect_labels(defect_posteriors(records)).select("row_id")
    sound = records.join(clean, "row_id", "left_anti").filter("length(instruction) > 20 and length(output) > 40")
    rows = [(r[0], r[1]) for r in sound.orderBy(F.xxhash64("row_id")).limit(sample).select("instruction", "output").collect()]
    cases = [(d, *votes(i, o)[:1]) for d, i, o in planted(rows, seed)]
    plain = [votes(i, o)[0] for i, o in rows]
    cutoffs, measured = {}, {}
    for k, d in enumerate(DEFECTS):
        score = lambda vs: models[d].posterior(np.array([pattern(v[k]) for v in vs], dtype=np.int64)) if vs else np.zeros(0)  # noqa: B023, E731
        hit, miss = score([v for c, v in cases if c == d]), score(plain)
        best = max(np.round(np.arange(0.05, 1.0, 0.05), 2), key=lambda t: (_f1(hit[::2], miss[::2], t), -abs(t - 0.5)))
        cutoffs[d] = float(best)
        measured[d] = (float((hit[1::2] > best).mean()) if len(hit) > 1 else 0.0, float((miss[1::2] > best).mean()) if len(miss) > 1 else 0.0)
    k = DEFECTS.index("refusal")
    unlisted = models["refusal"].posterior(np.array([pattern(votes(i, o)[0][k]) for i, _ in rows[:200] for o in UNLISTED_REFUSAL], dtype=np.int64)) if rows else np.zeros(1)
    measured["unlisted"] = (float((unlisted > cutoffs["refusal"]).mean()), measured["refusal"][1])
    return cutoffs, measured


def _f1(hit: np.ndarray, miss: np.ndarray, t: float) -> float:
    found, wrong = (hit > t).sum(), (miss > t).sum()
    return 2 * found / max(1, found + wrong + len(hit))
