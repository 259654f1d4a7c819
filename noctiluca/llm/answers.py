"""Broken prompt and response pairs, by ordered rules."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.llm.words import INVISIBLE, words
from noctiluca.session import bounded_batches, spread

DEFECTS = ("empty", "question_copy", "refusal", "other_language", "truncated")

# Function words by language. Words shared by several of the languages count for each of them.
FUNCTION_WORDS = {
    "en": "a the of and to in is are was were that this it its for with as by on at from which be been or an not than whereas while how what why does do did can could would should who where when their they there these those has have had between into under within only about we our more most each but if then so out over after before because since no yes he she his her my your you i me am unless alone one once such both",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind war waren wird werden wurde wurden mit von vom zu zum zur im in auf aus bei für durch über unter nach vor wie was warum welche welcher welches wer wo man sich es sie er wir ihr ich auch nur noch aber denn weil dass als am an beim kann können so sehr etwa diese dieser dieses dazu keine kein leider mir hier ohne lässt hat haben spielt welchen viele viel",
    "fr": "a le la les un une des du de et ou ne pas est sont était été être avec par pour dans sur sous aux au ce cette ces cet que qui quoi quel quelle quels quelles comment pourquoi où il elle ils elles on nous vous je se sa son ses leur leurs plus puis car mais donc si sans entre vers chez près d l n s qu c j m en à cela fait bien peu très même comme ont formés notre votre",
    "es": "a el la los las un una unos unas de del y o no es son era fue ser con por para en sobre al lo que qué quién cómo cuál cuáles dónde cuándo se su sus le les nos yo este esta estos estas ese esa más muy pero porque pues sin entre hasta desde han ha hay como ya apenas cada tan tiene tienen puede pueden cerca según también si tal ni mi desde nuestro",
    "it": "a il lo la i gli le un uno una di del dello della dei degli delle da dal dalla e ed o non è sono era erano essere con per tra fra in nel nella nei nelle su sul sulla sui al alla ai alle questo questa questi queste che chi cosa come quando dove perché si suo sua loro più molto ma anche già dopo prima sempre solo ha hanno stato stati state si sono viene vengono",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas e ou não é são era foram ser com por para pelo pela pelos pelas sobre ao aos que quem como quando onde porque se seu sua seus suas mais muito mas também já depois antes desde até apenas tem têm foi está estão esta este esse essa isso",
    "nl": "de het een en of niet is zijn was waren wordt worden werd werden met van voor door over onder naar bij uit op aan in dat die dit deze wat wie waar hoe wanneer omdat want maar ook nog al als dan er ze zij hij wij we om te zeer heeft hebben geen kan kunnen",
}
_LANGUAGES = tuple(FUNCTION_WORDS)
_WORDS_OF = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_SPOKEN = {w: tuple(i for i, lang in enumerate(_LANGUAGES) if w in _WORDS_OF[lang]) for w in frozenset().union(*_WORDS_OF.values())}
#: Letters that occur in one of the languages and hardly in the others.
_LETTERS = {"de": "ßäö", "fr": "èêàçùœ", "es": "ñíóáú", "en": "", "it": "òì", "pt": "ãõ", "nl": ""}
# What is put where an answer is missing. Words that can answer a question ("no", "unknown") are none.
PLACEHOLDERS = frozenset("""
null|none|nil|na|n a|nan|tbd|tba|todo|to do|to be added|to be done|to be determined|xxx|placeholder|lorem ipsum|no answer|none given|not given|not provided|not available|not applicable|no response|no answer given|no answer provided|answer pending
keine angabe|ohne angabe|keine antwort|k a|nicht verfügbar|wird ergänzt|aucune réponse|sans réponse|pas de réponse|sans objet|s o|non disponible|à compléter|sin respuesta|s d|no disponible|no aplica|por completar
""".strip().replace("\n", "|").split("|"))  # fmt: skip

# Refusals: the speaker says of itself that it will not or cannot answer. That something is impossible as a matter of
# fact ("cannot be measured", "models are unable to") has no speaker and is no refusal.
_REFUSALS = re.compile(
    r"""
      \b(?:i|we)\s+(?:\w+\s+){0,2}?(?:can\s?not|can['’]t|could\s+not|couldn['’]t|won['’]t|will\s+not|would\s+rather\s+not|would\s+prefer\s+not|must\s+decline|have\s+to\s+decline|decline|refuse|am\s+not\s+able|are\s+not\s+able|am\s+unable|are\s+unable|am\s+not\s+allowed|am\s+not\s+in\s+a\s+position)\b[^.;]{0,40}?\b(?:answer|help|assist|respond|comment|discuss|comply|reply|(?:say|tell|offer|provide|give)\s+(?:anything|more|you|an?\s+(?:\w+\s+)?answer|any))
    | \b(?:i|we)\s+(?:do\s+not|don['’]t)\s+have\s+(?:enough|the|any|sufficient)\s+(?:\w+\s+)?information\b
    | \b(?:unable|not\s+able|not\s+possible|impossible)\s+for\s+me\s+to\b | \b(?:unable|not\s+able)\s+to\s+(?:\w+\s+)?(?:answer|help|assist|respond|comment|comply)\b
    | \bmust\s+decline\b | \bi(?:['’]m|\s+am)\s+(?:\w+\s+)?(?:sorry|unable|afraid)\b.{0,60}\b(?:can|not|unable|answer|help|question)
    | \b(?:my\s+apologies|apologies|sorry)\b.{0,20}\b(?:unable|cannot|can['’]t|no\s+answer)\b | \boutside\s+(?:of\s+)?what\s+i\s+(?:am|can)\b | \bas\s+an?\s+(?:ai|language\s+model|assistant)\b
    | \bnot\s+possible\s+for\s+me\b | \bno\s+answer\s+can\s+be\s+given\b.{0,20}\bme\b | \bbeyond\s+what\s+i\s+(?:am|can)\b
    | \b(?:kann|darf|möchte|will|werde)\s+ich\b[^.;]{0,50}\b(?:nicht|nichts|keine)\b | \bich\s+(?:kann|darf|möchte|will|werde|bin|muss|habe)\b[^.;]{0,60}\b(?:nicht|nichts|keine|leider|ablehnen|außerstande|verzichten)\b[^.;]{0,40}\b(?:antwort\w*|beantwort\w*|helfen|weiterhelfen|auskunft|äußern|kommentieren|sagen|stellung|dienen|informationen|angaben|lage)\b | \bich\s+(?:muss|möchte)\b[^.;]{0,60}\b(?:ablehnen|verzichten)\b | \bmir\s+(?:ist|liegen|fehlen)\b.{0,30}\b(?:nicht|keine|informationen|angaben)\b | \b(?:tut|täte)\s+mir\s+leid\b
    | \bje\s+(?:\w+\s+)?(?:ne\s+|n['’]\s*)(?:\w+\s+)?(?:peux|puis|suis|veux|souhaite|sais|ai|dispose|préfère)\b[^.;]{0,50}\b(?:répondre|réponse|aider|commenter|dire|fournir|donner|discuter|question|informations?|mesure)\b | \bje\s+suis\s+(?:désolée?|navrée?|au\s+regret)\b | \bje\s+(?:préfère|dois)\s+(?:ne|refuser|décliner)\b | \b(?:désolée?|navrée?)\b.{0,30}\b(?:je|pas|répondre)\b | \bil\s+(?:ne\s+)?m['’]est\s+(?:pas\s+possible|impossible)\b
    | \b(?:no|tampoco)\s+(?:me\s+es\s+posible|puedo|podemos|podré|quiero|deseo|sé|dispongo|tengo|estoy)\b.{0,50}\b(?:responder|contestar|ayudar|comentar|información|respuesta|pregunta|decir|opinar|hablar|autorizad[oa]|condiciones|capacidad)\b | \blo\s+siento\b | \b(?:prefiero|debo)\s+(?:no|declinar|rechazar|abstenerme)\b | \bme\s+(?:es\s+imposible|veo\s+obligad[oa])\b
    """,
    re.X | re.I | re.S,
)
#: Words of which one stands in every refusal, so that other answers need no search.
_SPEAKER = frozenset("i we unable apologies sorry able possible impossible decline answer outside beyond assistant ai model ich mir je j désolé désolée navré navrée m no tampoco lo prefiero debo me".split())
#: Words after which no sentence ends.
_DANGLING = frozenset(
    "the a an of and or to in with for by from as at on because since that which whose than into between under within see e.g i.e der die das den dem des ein eine einen einem einer und oder mit von zu zum zur im auf aus bei für durch wegen weil dass le la les un une du de des et ou avec par pour dans sur à au aux que el los las una y o con por en del al que debido causa sin".split()
)
#: Words that open a sentence as its subject, that only stand in a clause, and articles that open one.
_SUBJECTS = frozenset("it they we he she these those there es sie wir dieser diese dieses man ils elles il elle on nous cela ce ceux se lo ellos ellas esto estos hay".split())
_CLAUSE = frozenset("is are was were be been has have had does do did can could would should will may might must because which that while whereas although unless when if then thereby thus hence ist sind war waren wird werden wurde wurden hat haben kann können weil dass denn est sont était ont peut peuvent sera parce car tandis es son fue fueron ha han puede pueden porque aunque mientras they it we".split())
_ARTICLES = frozenset("the der die das le la les el los las".split())
_SENTENCE = re.compile(r"[.!?;…。！？][\"'”’»)\]]*\s+\S")
_INTRODUCTIONS = re.compile(r"^(?:the question is|question|q|you asked|you ask|your question was|the question was|prompt|frage|die frage lautet|la question est|pregunta|la pregunta es)\s*[:：-]?\s*", re.I)
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|[a-z]\))\s+\S")


def language_scores(tokens: list[str]) -> dict[str, float]:
    """Share of function words of each language, with a little for letters of its own."""
    counts = [0.0] * len(_LANGUAGES)
    for t in tokens:
        for i in _SPOKEN.get(t, ()):
            counts[i] += 1
    letters = "".join(tokens)
    n = max(1, len(tokens))
    own = (0.0 if letters.isascii() else 0.3 * sum(letters.count(c) for c in _LETTERS[lang]) for lang in _LANGUAGES)
    return {lang: (c + x) / n for lang, c, x in zip(_LANGUAGES, counts, own, strict=True)}


def language(tokens: list[str], lead: float = 0.08) -> str | None:
    """The language whose function words lead the others' clearly, or None."""
    if len(tokens) < 3:
        return None
    ranked = sorted(language_scores(tokens).items(), key=lambda x: (-x[1], x[0]))
    return ranked[0][0] if ranked[0][1] > 0 and ranked[0][1] - ranked[1][1] >= lead else None


def speaks_otherwise(asked: list[str], said: list[str], lead: float = 0.08) -> bool:
    """Whether an answer is in another language than its question: the question's language is clear, and in the answer
    another one's function words lead that one's clearly. Which other one it is need not be clear."""
    mine = language(asked)
    if not mine or len(said) < 3:
        return False
    scores = language_scores(said)
    return max(v for lang, v in scores.items() if lang != mine) - scores[mine] >= lead


@functools.lru_cache(65_536)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "?").split()[0]


def scripts(text: str) -> set[str]:
    return {_script(c) for c in set(text) if c.isalpha()} - {"MODIFIER", "?"}


def _truncated(body: str) -> bool:
    """Whether a non-empty answer (without the repeated question) breaks off inside a sentence."""
    body = body.rstrip()
    stripped = body.rstrip("\"'”’»")
    if _END.search(body):
        opened = max((body.rfind(a) for a in "([{" if body.count(a) > body.count({"(": ")", "[": "]", "{": "}"}[a])), default=-1)
        last = re.findall(r"[^\W\d_]+", stripped.rstrip(".!?…"))
        return opened >= 0 and len(body) - opened < 60 and "." not in body[opened:-1] or body.endswith(("...", "…")) and bool(last)
    lines = [line for line in body.split("\n") if line.strip()]
    if lines and _ITEM.match(lines[-1]):
        tail = words(lines[-1])
        return lines[-1].rstrip().endswith((",", ";", "(", "-")) or bool(tail) and tail[-1] in _DANGLING
    if stripped.endswith((",", ";", ":", "(", "[", "-", "–", "—", "/", "&")) or body.count("(") > body.count(")") or body.count("[") > body.count("]"):
        return True
    tokens = words(body)
    if not tokens:
        return False
    if tokens[-1] in _DANGLING:
        return True
    # without a full stop only what shows that a sentence had begun: one before it, a clause of its own, or more words than a
    # phrase has, and the stump of a word. A name, a quantity or a phrase is an answer as it stands.
    if len(tokens) > 8 or _SENTENCE.search(body):
        return True
    clause = tokens[0] in _SUBJECTS or any(t in _CLAUSE for t in tokens)
    return len(tokens) > 1 and clause or len(tokens) > 3 and tokens[0] in _ARTICLES and len(tokens[-1]) < 4 and not tokens[-1].isdigit()


def defects(question: str | None, answer: str | None) -> list[str]:
    """Every defect that a rule triggers, in the order of DEFECTS. An empty answer has no further ones."""
    visible = re.sub(r"</?[A-Za-z][^<>]*>", " ", INVISIBLE.sub("", answer or ""))
    mine = words(visible)
    bare = " ".join(mine)
    if not mine or bare in PLACEHOLDERS:
        return ["empty"]
    asked = words(question or "")
    found: list[str] = []
    rest = words(_INTRODUCTIONS.sub("", visible.strip()))
    copied = rest
    while asked and copied[: len(asked)] == asked:
        copied = copied[len(asked) :]
    if asked and not copied:
        found.append("question_copy")
    body = visible
    if asked and mine[: len(asked)] == asked and len(mine) > len(asked):  # the question, then an answer
        at = 0
        for m in re.finditer(r"[^\W_]+", visible):
            at += 1
            if at == len(asked):
                body = visible[m.end() :].lstrip(" \t.?!: ¿")
                break
    said = words(body)
    if not _SPEAKER.isdisjoint(said) and _REFUSALS.search(body):
        found.append("refusal")
    if speaks_otherwise(asked, said) or question and asked and not (scripts(question) & scripts(body)) and scripts(question) and scripts(body):
        found.append("other_language")
    if "question_copy" not in found and _truncated(body):
        found.append("truncated")
    return [d for d in DEFECTS if d in found]


def flag_pairs(pairs: DataFrame, id_col: str = "id", question_col: str = "question", answer_col: str = "reference_answer") -> DataFrame:
    """(id, defects, defect): all triggered defects of each pair in rule order and the first of them (null if sound).

    A null, blank or placeholder answer is 'empty'. A null or blank question leaves the rules that need one silent.
    Repeated rows stay repeated, other columns are not read, an empty table gives no rows.
    """
    flat = pairs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{question_col}`").cast("string").alias("question"), F.col(f"`{answer_col}`").cast("string").alias("answer"))

    bounded_batches(pairs.sparkSession)

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defects(q, a) for q, a in zip(b["question"], b["answer"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "defects": found, "defect": [d[0] if d else None for d in found]})

    return spread(flat).mapInPandas(flag, "id string, defects array<string>, defect string")


def defective(flagged: DataFrame) -> DataFrame:
    """(id, defect): the pairs with a defect, each once with its first in rule order, also among the rows of a repeated id."""
    place = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return flagged.where(F.col("defect").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min_by("defect", place).alias("defect"))
