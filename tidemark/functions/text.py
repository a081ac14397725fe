"""Scalar text functions: times, categories, parsers, scores. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, keywords and labels that decide results.
TIME_PATTERNS = (r"(\d{1,2}):(\d{2}):(\d{2})", r"(\d{1,2}):(\d{2})", r"at\s+(\d+(?:\.\d+)?)\s*(?:sec|seconds?|s)?", r"around\s+(\d+(?:\.\d+)?)\s*(?:sec|seconds?|s)?")
FOLLOW_UP = (
    r"\bwhat happened next\b", r"\bwhat about\b", r"\band then\b", r"\bafter that\b", r"\bbefore that\b",
    r"\bwhy did (he|she|they|it|the player)\b", r"\bwhat did (he|she|they|it|the player) do\b", r"\bcan you explain more\b",
    r"\btell me more\b", r"\bwhat else\b", r"\bhow did that happen\b", r"\bwhy\?$", r"^why\b", r"^how\b", r"^what\b.*\bthat\b", r"\bthe same\b", r"\bit\b.*\?$",
)
AUDIO_KEYWORDS = {
    "music": ("music", "melody", "song", "tune", "beat", "rhythm"),
    "effect": ("explosion", "crash", "bang", "hit", "impact", "shot"),
    "ambient": ("wind", "rain", "water", "birds", "traffic", "crowd"),
    "ui": ("click", "beep", "notification", "chime", "alert"),
}
GAMES = (
    (r"elden\s*ring", "Elden Ring", "action-rpg"), (r"dark\s*souls\s*(iii|3)", "Dark Souls 3", "action-rpg"), (r"dark\s*souls\s*(ii|2)", "Dark Souls 2", "action-rpg"),
    (r"dark\s*souls", "Dark Souls", "action-rpg"), (r"bloodborne", "Bloodborne", "action-rpg"), (r"sekiro", "Sekiro: Shadows Die Twice", "action-rpg"),
    (r"minecraft", "Minecraft", "sandbox"), (r"fortnite", "Fortnite", "battle-royale"), (r"valorant", "Valorant", "fps"),
    (r"league\s*of\s*legends|lol", "League of Legends", "moba"), (r"counter[\-\s]?strike|cs:?go|cs2", "Counter-Strike", "fps"), (r"overwatch", "Overwatch", "fps"),
    (r"apex\s*legends", "Apex Legends", "battle-royale"), (r"call\s*of\s*duty|cod|warzone", "Call of Duty", "fps"), (r"gta|grand\s*theft\s*auto", "Grand Theft Auto", "action"),
    (r"zelda|breath\s*of\s*the\s*wild|tears\s*of\s*the\s*kingdom", "The Legend of Zelda", "action-adventure"), (r"pokemon|pok[eé]mon", "Pokemon", "rpg"), (r"fifa|ea\s*sports\s*fc", "EA Sports FC", "sports"),
    (r"rocket\s*league", "Rocket League", "sports"), (r"cyberpunk\s*2077", "Cyberpunk 2077", "action-rpg"), (r"the\s*witcher\s*3|witcher\s*3", "The Witcher 3", "action-rpg"),
    (r"baldur'?s\s*gate\s*3|bg3", "Baldur's Gate 3", "rpg"), (r"diablo\s*(iv|4)", "Diablo 4", "action-rpg"), (r"world\s*of\s*warcraft|wow", "World of Warcraft", "mmorpg"),
    (r"final\s*fantasy\s*(xiv|14)", "Final Fantasy XIV", "mmorpg"), (r"destiny\s*2", "Destiny 2", "fps"), (r"hades\s*(ii|2)?", "Hades", "roguelike"),
    (r"hollow\s*knight", "Hollow Knight", "metroidvania"), (r"celeste", "Celeste", "platformer"), (r"stardew\s*valley", "Stardew Valley", "simulation"),
    (r"terraria", "Terraria", "sandbox"), (r"among\s*us", "Among Us", "social-deduction"),
)
SOURCES = (("fandom", ("fandom.com", "wikia.com")), ("fextralife", ("fextralife.com",)), ("wikipedia", ("wikipedia.org",)), ("ign", ("ign.com",)), ("gamespot", ("gamespot.com", "gamefaqs")), ("reddit", ("reddit.com",)), ("youtube", ("youtube.com",)), ("steam", ("steam",)))
DENIALS = (
    "no glitch", "no visible glitch", "is not a glitch", "isn't a glitch", "normal gameplay", "this is normal", "nothing unusual", "no clear indication", "no indication of a glitch", "not a glitch",
    "no specific glitch", "no obvious glitch", "appears normal", "no anomalies", "looks normal", "nothing abnormal", "no visual evidence", "no signs of", "no physics error", "no clipping",
)
AFFIRMATIONS = (
    "there is a glitch", "yes, there is", "is a glitch", "glitch detected", "appears to be a glitch", "clearly a glitch", "this is a glitch", "visible glitch",
    "glitch in this", "glitch can be seen", "glitch is present", "physics error", "clipping error", "texture error", "animation bug",
)
NEGATION = r"\b(no|not|isn't|aren't|wasn't|weren't|don't|doesn't|didn't|without|lacks?|absence)\b"
ATTACKS = ("attacks", "casts a spell", "strikes", "parry", "dodge", "performs", "uses", "summons", "charges")
EFFECTS = ("damage", "hit", "critical", "wounds", "burns", "perfect", "broken", "stunned", "enraged", "defeated")
VICTORIES = ("victory", "battle loot", "xp", "defeated the")
SKILLS = ("stains", "overcharge", "immolation", "healing", "recovery", "assault", "thunderfall")
LONG_VIDEO_TASKS = (("needle", "needle_in_haystack"), ("anomaly", "glitch_detection"), ("action_order", "temporal_reasoning"), ("action_count", "visual_qa"), ("plot", "temporal_reasoning"), ("topic", "visual_qa"), ("ego", "visual_qa"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_of(text: Column, choices, otherwise: Column) -> Column:
    """The label of the first of (label, substrings) that the text contains."""
    out = None
    for label, words in choices:
        out = F.when(any_of(text, words), label) if out is None else out.when(any_of(text, words), label)
    return out.otherwise(otherwise)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def mmss(seconds: Column) -> Column:
    """MM:SS, minutes unbounded."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def tenths(x: Column) -> Column:
    """A double with one decimal, rounded from its exact value, ties to even, as C, Python and SQL's printf do. (``format_string`` rounds the shortest decimal that stands for the double, half up: 0.15 is 0.2 there and 0.1 here.) From 2^63 on, and for what is no number, it is ``format_string``'s text."""
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    # Ten times the part is near + rest exactly; where near lies halfway between two tenths, the rest decides.
    near = 8 * part + 2 * part
    rest = 2 * part - (near - 8 * part)
    half = near - F.floor(near) == 0.5
    digit = F.when(half & (rest > 0), F.ceil(near)).when(half & (rest < 0), F.floor(near)).otherwise(F.rint(near).cast("bigint"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, (whole + F.floor(digit / 10)).cast("string"), F.lit("."), (digit % 10).cast("string"))
    return F.when(x.isNotNull(), F.when(size < 2.0**63, text).otherwise(F.format_string("%.1f", x)))


def time_token(seconds: Column) -> Column:
    return F.concat(F.lit("<ts="), mmss(seconds), F.lit(">"))


def token_seconds(token: Column) -> Column:
    """Seconds of ``<ts=M:S>``; null without."""
    p = r"<ts=(\d+):(\d+)>"
    return F.when(token.rlike(p), F.regexp_extract(token, p, 1).try_cast("double") * 60 + F.regexp_extract(token, p, 2).try_cast("double"))


def query_seconds(query: Column) -> Column:
    """The time a question names: H:M:S, then M:S, then ``at N``, then ``around N``; null without."""
    q = F.lower(query)
    part = lambda k, g: F.regexp_extract(q, TIME_PATTERNS[k], g).try_cast("double")
    return F.coalesce(
        F.when(q.rlike(TIME_PATTERNS[0]), part(0, 1) * 3600 + part(0, 2) * 60 + part(0, 3)),
        F.when(q.rlike(TIME_PATTERNS[1]), part(1, 1) * 60 + part(1, 2)),
        F.when(q.rlike(TIME_PATTERNS[2]), part(2, 1)),
        F.when(q.rlike(TIME_PATTERNS[3]), part(3, 1)),
    )


def is_follow_up(query: Column) -> Column:
    return stripped(F.lower(query)).rlike("|".join(f"(?:{p})" for p in FOLLOW_UP))


def compact(t: Column, modality: Column, text: Column) -> Column:
    """One transcript line by modality."""
    body = F.when(modality == "speech", F.concat(F.lit('"'), text, F.lit('"'))).when(modality == "audio", F.concat(F.lit("(Audio: "), text, F.lit(")"))).when(modality == "ocr", F.concat(F.lit('(Text: "'), text, F.lit('")'))).otherwise(text)
    return F.concat(F.lit("["), mmss(t), F.lit("] "), body)


def verbose(t: Column, entity: Column, modality: Column, text: Column) -> Column:
    who = F.when(entity.isNotNull() & (entity != ""), F.concat(F.lit(" ["), entity, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), mmss(t), F.lit("]"), who, F.lit(" ("), modality, F.lit(") "), text)


def interleaved(t: Column, kind: Column, text: Column, embeddings: bool = False) -> Column:
    """``<ts=MM:SS> <r|a|v> text``: what is seen, heard, or a video; with ``embeddings`` the tags are those of their embeddings, and other kinds have none."""
    tag = lambda name: f"<{name}_emb>" if embeddings else f"<{name}>"
    tags = F.when(kind == "visual", tag("r")).when(kind == "audio", tag("a")).when(kind == "video", tag("v"))
    return F.concat_ws(" ", time_token(t), tags, text)


def frame_at(t: Column, fps: int = 10) -> Column:
    """The frame that is about at a time."""
    return (t * fps).cast("bigint")


def ocr_category(text: Column) -> Column:
    """damage, health, level, time, currency or general, by the first rule that holds; null for blank text."""
    t = stripped(text)
    low = F.lower(t)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(t.rlike(r"^[0-9]{1,6}$"), "damage").when(any_of(low, ("hp", "health", "/")), "health")
        .when(any_of(low, ("lv", "level")), "level").when(t.contains(":") & t.rlike("[0-9]"), "time").when(any_of(t, ("$", "gold", "coins")), "currency").otherwise("general")
    )


def audio_types(text: Column) -> Column:
    """array of (type, confidence): each type with a keyword at 0.8, else ambient at 0.5 unless it says silence."""


    def types(low: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(any_of(low, w), F.struct(F.lit(k).alias("type"), F.lit(0.8).alias("confidence"))) for k, w in AUDIO_KEYWORDS.items()]))
        none = F.when(low.contains("silence"), F.array().cast("array<struct<type:string,confidence:double>>")).otherwise(F.array(F.struct(F.lit("ambient").alias("type"), F.lit(0.5).alias("confidence"))))
        return F.when(F.size(found) > 0, found).otherwise(none)

    # The text is lower-cased once, not once a keyword.
    return F.transform(F.array(F.lower(text)), types)[0]


def game_of(text: Column) -> Column:
    """(name, genre) of the first game named; null without."""
    low = F.lower(text)
    out = None
    for pattern, name, genre in GAMES:
        value = F.struct(F.lit(name).alias("name"), F.lit(genre).alias("genre"))
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def game_by_evidence(ocr: Column, speech: Column, other: Column) -> Column:
    """(name, genre, confidence) of the first evidence that names a game: text on screen at 0.8, speech at 0.6, anything else at 0.5."""
    found = lambda text, c: F.when(game_of(text).isNotNull(), F.struct(game_of(text)["name"].alias("name"), game_of(text)["genre"].alias("genre"), F.lit(c).alias("confidence")))
    return F.coalesce(found(ocr, 0.8), found(speech, 0.6), found(other, 0.5))


def source_of(url: Column) -> Column:
    return first_of(F.lower(url), SOURCES, F.lit("web"))


def tool_calls(text: Column) -> Column:
    """Arguments of ``<tool_call>name("args")</tool_call>`` for the one known tool, search_game_knowledge."""
    return F.regexp_extract_all(text, F.lit(r'(?is)<tool_call>\s*search_game_knowledge\s*\(\s*["\'](.*?)["\']\s*\)\s*</tool_call>'), F.lit(1))


def without_tool_calls(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?is)<tool_call>.*?</tool_call>", ""))


def confidence(n_events: Column, query: Column, response: Column, probs: Column | None = None) -> Column:
    """Score of an answer in [0, 1]: context, citations, structure and specificity, scaled by token probabilities if given."""
    cited = F.size(F.regexp_extract_all(response, F.lit(r"\[?\d{1,2}:\d{2}\]?"), F.lit(0)))
    ctx = F.when(n_events >= 3, 0.3).otherwise(n_events * 0.1)
    reason = response.contains("**Reasoning:**") | F.lower(response).contains("because")
    answer = response.contains("**Answer:**")
    structure = F.when(F.length(response) > 50, F.when(reason & answer, 0.25).when(reason | answer, 0.15).otherwise(0.1)).otherwise(0.05)
    asked = query_seconds(query).isNotNull()
    special = F.when(~asked, 0.15).when(query_seconds(response).isNotNull(), 0.2).otherwise(0.05)
    total = ctx + F.least(F.lit(0.25), cited * 0.05) + structure + special
    if probs is not None:
        mean = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p) / F.greatest(F.size(probs), F.lit(1))
        total = F.when(F.size(probs) > 0, total * (0.5 + 0.5 * mean)).otherwise(total)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def prompt(question: Column, options: Column) -> Column:
    """The question with its lettered options."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), o))
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(question)


def choice_prompt(question: Column, options: Column) -> Column:
    lines = F.transform(options, lambda o, i: F.concat(F.lit("  ("), F.char(F.lit(65) + i), F.lit(") "), o))
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with the letter only."))).otherwise(question)


def parsed_answer(response: Column, options: Column) -> Column:
    """An answer from free text: a letter in four ways, then yes or no, then the first line."""
    r = stripped(response)
    up, low = F.upper(r), F.lower(r)
    letter = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    hits = F.array_compact(F.transform(options, lambda o, i: F.when(low.contains(F.lower(o)), F.char(F.lit(65) + i))))
    mcq = F.when(F.size(options) > 0, F.coalesce(letter(r"^([A-D])\b"), letter(r"[\(\[]([A-D])[\)\]]"), letter(r"(?:answer|option)[:\s]+([A-D])\b"), F.try_element_at(hits, F.lit(1))))
    plain = F.when(low.contains("yes") | low.contains("true"), "yes").when(low.contains("no") | low.contains("false"), "no").otherwise(F.substring(F.split(r, "\n")[0], 1, 200))
    return F.when(response.isNull() | (response == ""), "").otherwise(F.coalesce(mcq, plain))


def glitch_answer(response: Column, options: Column) -> Column:
    """Negation-aware yes or no: denials, then the first affirmation found (no where a negation stands within 30 characters before it), then how the text starts, then its answer section, then its first line."""
    r = stripped(response)
    low = F.lower(r)
    letter = F.when(F.size(options) > 0, F.nullif(F.regexp_extract(F.upper(r), r"^([A-D])\b", 1), F.lit("")))
    out = F.when(letter.isNotNull(), letter).when(any_of(low, DENIALS), "no")
    for phrase in AFFIRMATIONS:
        # of every occurrence, the 30 characters before it
        parts = F.split(low, phrase.replace(".", r"\."), -1)
        before = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat_ws(phrase, F.slice(parts, F.lit(1), k)))
        negated = F.exists(before, lambda b: F.right(b, F.lit(30)).rlike(NEGATION))
        out = out.when(low.contains(phrase), F.when(negated, "no").otherwise("yes"))
    section = stripped(F.regexp_extract(low, r"\*\*answer[:\s]*\*\*\s*([^\n]+)", 1))
    out = out.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")
    out = out.when(any_of(section, ("yes", "glitch", "bug")), "yes").when(any_of(section, ("no", "normal")), "no")
    return F.when(response.isNull() | (response == ""), "").otherwise(out.otherwise(F.substring(F.split(r, "\n")[0], 1, 200)))


def correct_keywords(predicted: Column, truth: Column, options: Column) -> Column:
    """Equality, then the sentiment of keywords against a yes/no truth, then the first letter."""
    p, t = stripped(F.lower(predicted)), stripped(F.lower(truth))
    yes = any_of(p, ("yes", "glitch", "bug", "error", "anomaly", "issue", "problem"))
    no = any_of(p, ("no", "normal", "correct", "fine", "nothing wrong")) & ~F.substring(p, 1, 50).contains("not")
    first = F.upper(F.substring(p, 1, 1))
    by_letter = (F.size(options) > 0) & first.isin("A", "B", "C", "D") & (first == F.upper(F.substring(t, 1, 1)))
    return (p == t) | (yes & ~no & t.isin("yes", "true", "1", "glitch", "a")) | (no & ~yes & t.isin("no", "false", "0", "normal", "b")) | by_letter


def correct_letters(predicted: Column, truth: Column, letters: str = "abcd", variants: bool = True) -> Column:
    """Equality, then the first letters if both are options, then variants of yes and no."""
    p, t = stripped(F.lower(predicted)), stripped(F.lower(truth))
    a, b = F.substring(p, 1, 1), F.substring(t, 1, 1)
    both = a.isin(*letters) & b.isin(*letters)
    out = F.when(p == t, True).when(both, a == b)
    if variants:
        out = out.when(p.isin("yes", "true", "1", "correct") & t.isin("yes", "true", "1", "correct"), True).when(p.isin("no", "false", "0", "incorrect") & t.isin("no", "false", "0", "incorrect"), True)
    return out.otherwise(False)


def correct_exact(predicted: Column, truth: Column) -> Column:
    return stripped(F.lower(predicted)) == stripped(F.lower(truth))


def long_video_task(task: Column) -> Column:
    return first_of(F.lower(task), [(label, (word,)) for word, label in LONG_VIDEO_TASKS], F.lit("visual_qa"))


def long_question_task(task: Column, question: Column) -> Column:
    """Temporal where the task says so or the question asks when, else visual."""
    return F.when(F.lower(F.coalesce(task, F.lit(""))).contains("temporal") | F.lower(question).contains("when"), "temporal_reasoning").otherwise("visual_qa")


def answer_format(task: Column, options: Column, answer: Column) -> Column:
    return F.when(task == "bug_report", "free_text").when(F.size(options) > 0, "mcq").when(F.lower(answer).isin("yes", "no", "true", "false"), "binary").otherwise("free_text")


def output_tokens(predicted: Column) -> Column:
    """Twice the number of words."""
    return F.size(F.regexp_extract_all(predicted, F.lit(r"\S+"), F.lit(0))) * 2


def model_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "whisper-", "")
