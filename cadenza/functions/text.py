"""Text repair, cleaning and classification as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cadenza.core.session import settings

# Patterns that mark text decoded with the wrong charset.
DAMAGE_MARKERS = [
    "[\\uE000-\\uF8FF]", "銆\\?", "锛\\?", "鈥\\?", "€\\?", "(?:鐨|鍔ㄤ|璁|瑙|缁|闂|绋|鎷|杩|寤鸿|璇|浣|鏁)",
]
# Punctuation that lost its last byte, and what it was.
BROKEN_PUNCTUATION = {"銆?": "。", "锛?": "，", "鈥?": "“", "€?": "。"}
# Exercise terms and their translations.
TERMS = {
    "lat pulldown": "高位下拉",
    "bench press": "卧推",
    "romanian deadlift": "罗马尼亚硬拉",
    "hack squat": "哈克深蹲",
    "hip thrust": "臀桥",
    "lateral raise": "侧平举",
    "face pull": "面拉",
    "pull[ -]?up": "引体向上",
    "chest press": "推胸",
    "leg extension": "腿屈伸",
    "leg curl": "腿弯举",
    "biceps curl": "肱二头肌弯举",
    "triceps extension": "肱三头肌拉伸",
    "goblet squat": "高脚杯深蹲",
    "barbell squat": "杠铃深蹲",
    "dumbbell press": "哑铃卧推",
    "shoulder press": "肩上推举",
}
# Tool words that must not reach users, and their replacement.
BANNED = [
    "MediaPipe", "Mediapipe", "OpenPose", "OpenCV", "tracking pollution", "invalid frame", "model recognition error",
    "pose engine", "tracking failure", "骨架追踪", "骨骼追踪污染", "污染帧", "数据作废", "筛选帧", "自动判断",
]
BANNED_REPLACEMENT = "动作分析"
ENDS = "。！？!?；;"
# Sentences about filming or about raw metrics are not shown.
FILMING = "(?i)拍摄|重拍|补拍|机位|镜头|入镜|取景|相机|摄像|画面角度"
METRIC_WORDS = "(?i)覆盖率|置信度|可见度|识别率"


def charsets(spark: SparkSession):
    """Block in which GB18030 can be read: it needs the legacy charset switch;
    bytes it cannot map become replacement characters, which the repair then
    refuses.  Results have to be stored inside the block."""
    return settings(spark, {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"})


def translate_terms(c: Column) -> Column:
    """Exercise terms in Chinese; a text that holds the start of none is not searched."""
    starts = [term.split("[")[0] for term in TERMS]
    found = F.exists(F.array(F.lower(c)), lambda low: reduce(Column.__or__, [low.contains(t) for t in starts]))
    out = c
    for term, word in TERMS.items():
        out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])", word)
    return F.when(found, out).otherwise(c)


def damage_score(c: Column) -> Column:
    score = F.lit(0)
    for pattern in DAMAGE_MARKERS:
        score = score + F.regexp_count(c, F.lit(pattern))
    return score


def repair_text(c: Column) -> Column:
    """Undo UTF-8 text that was read as GB18030; text that cannot be repaired for
    sure becomes empty.  Runs inside ``charsets``."""
    original = F.coalesce(c, F.lit(""))
    before = damage_score(original)
    guarded = original
    for i, broken in enumerate(BROKEN_PUNCTUATION):
        guarded = F.replace(guarded, F.lit(broken), F.lit(f"\u0001{i}\u0002"))
    candidate = F.try_validate_utf8(F.encode(guarded, "GB18030").cast("string"))
    for i, whole in enumerate(BROKEN_PUNCTUATION.values()):
        candidate = F.replace(candidate, F.lit(f"\u0001{i}\u0002"), F.lit(whole))
    # every marker holds a sign from U+20AC on
    suspicious = original.rlike("[\\u20AC-\\uFFFF]") & ((before >= 2) | original.rlike("[\\uE000-\\uF8FF]|銆\\?|锛\\?|鈥\\?|€\\?"))
    better = candidate.isNotNull() & ~candidate.contains("�") & (damage_score(candidate) < before)
    return F.when(~suspicious, translate_terms(original)).when(better, translate_terms(candidate)).otherwise("")


def _capped(c: Column, maximum: int | None) -> Column:
    return c if maximum is None else F.substring(c, 1, maximum)


def clean_text(c: Column, maximum: int | None = None) -> Column:
    """Trim and hide tool words; ``maximum`` cuts the text, None keeps all of it."""
    c = F.trim(c)
    for word in BANNED:
        c = F.replace(c, F.lit(word), F.lit(BANNED_REPLACEMENT))
    return _capped(c, maximum)


def squeeze(c: Column, maximum: int | None = None) -> Column:
    """Collapse white space and trim."""
    return _capped(F.trim(F.regexp_replace(c, r"\s+", " ")), maximum)


def clean_list(items: Column, max_items: int | None = None, max_chars: int | None = None) -> Column:
    cleaned = F.filter(F.transform(items, lambda t: clean_text(t, max_chars)), lambda t: t != "")
    return cleaned if max_items is None else F.slice(cleaned, 1, max_items)


def split_sentences(c: Column) -> Column:
    """What lies between sentence ends, each with its end.  Same as all matches of
    ``[^ends]+[ends]?``, whose greedy run over signs that are no end takes several
    times as long on real texts."""
    return F.filter(F.split(c, f"(?<=[{ENDS}])"), lambda s: ~s.isin("", *ENDS))


def drop_sentences(c: Column, patterns: Sequence[str] = (FILMING, METRIC_WORDS), maximum: int | None = None) -> Column:
    """Keep the sentences that match none of the patterns."""
    text = squeeze(c, None if maximum is None else 2 * maximum)
    sentences = F.transform(split_sentences(text), lambda s: F.trim(s))
    keep = lambda s: (s != "") & ~_any(s, patterns)
    return _capped(F.array_join(F.filter(sentences, keep), ""), maximum)


def _any(s: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | s.rlike(p)
    return hit


def text_key(c: Column) -> Column:
    """Comparison key without punctuation, white space and case."""
    return F.lower(F.regexp_replace(c, r"[\s，。！？!?；;：:、]", ""))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


# Issue categories in order of precedence.
CATEGORIES = {
    "range_endpoints": "RANGE|DEPTH|TOP|BOTTOM|ENDPOINT|EXTENSION|FLEXION|ANGLE",
    "stability_compensation": "STABILITY|SWAY|TRUNK|TORSO|SUPPORT|FOOT|HIP_LIFT|MOMENTUM|LEAN",
    "tempo_consistency": "TEMPO|CONTROL|RETURN|ECCENTRIC|PAUSE|CYCLE|REP_|TIMING",
    "load_safety": "SAFETY|PAIN|DANGEROUS|INSUFFICIENT_EVIDENCE|ACTION_MISMATCH",
}


def issue_category(code: Column, title: Column) -> Column:
    text = F.upper(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(title, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, pattern in CATEGORIES.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("movement_task")


def parse_json_object(c: Column) -> Column:
    """A JSON object as text: the whole value, else what lies between the outermost
    braces; NULL when neither parses."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(c)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    part = F.try_parse_json(inner)
    return F.when(is_object, F.to_json(whole)).otherwise(F.to_json(part))


def report_markdown(title: Column, facts: dict[str, Column], sections: dict[str, Column]) -> Column:
    """Markdown text: a title, a list of facts, one section per list of lines."""
    parts = [F.concat(F.lit("# "), title), F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), v) for k, v in facts.items()])]
    for name, lines in sections.items():
        bullets = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
        parts += [F.lit(f"## {name}"), bullets]
    return F.concat_ws("\n\n", *parts)
