"""Patterns of replies by family and place, what they call for, and replies without their closing phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.replies import hedging_density, normalized_entropy, stripped

# Patterns of each family, in the order in which they are told.
CLOSINGS = (
    r"what(?:'s| is| would be) the first step",
    r"i(?:'ll| will) help you (?:map|work|figure|sort|think) (?:it |that |this )?out",
    r"let me know (?:what you need|if you need|how i can|what i can)",
    r"what would you like to (?:do|try|start with|focus on)",
    r"let(?:'s| us) (?:tackle|work on|start with|break (?:it|this|that) down)",
    r"what(?:'s| is) (?:holding you back|stopping you|in your way)",
    r"i(?:'m| am) here (?:if|when|whenever) you (?:want|need|are ready)",
    r"navigate (?:your|the) (?:brain|mind|thought|inner|emotional)(?:'s)? (?:labyrinth|landscape|terrain|maze)",
    r"(?:give yourself|give you) (?:permission|grace|space) to",
    r"you(?:'ve| have) got this",
    r"trust (?:the|your) (?:process|journey|path|instinct)",
    r"(?:lean into|sit with|hold space for) (?:the|your|that)",
    r"(?:it(?:'s| is)|that(?:'s| is)) a (?:journey|process|marathon|practice)",
    r"would you like (?:me to )?(?:look|search|find|check|explore)",
    r"want me to (?:look|find|check|dig|explore).*(?:for you|into)",
    r"shall i (?:look|search|find|check|dig)",
    r"(?:can|could) i help you (?:with|find|look|search)",
    r"how (?:are you|do you) (?:feeling|feel)(?: about)?(?: that| this| it)?",
    r"how does (?:that|this|it) feel",
    r"though i(?:'d| would) still (?:bet|think|guess)",
    r"what(?:'s| is) the (?:issue|problem|thing|challenge)(?: you(?:'re| are))?(?: trying)? to (?:resolve|solve|address|figure out|work through|tackle)",
    r"is there (?:something|anything)(?: specific| in particular)? (?:you(?:'d| would) like to|that you(?:'d| would) want to)(?: (?:explore|discuss|share|focus on|talk about|dig into))",
    r"what(?:'s| is) actually (?:on|not on) the (?:list|table|agenda)(?: that)?(?: feels| seems)?(?: like it should be)?",
)
CIRCULAR = (
    r"(?:we(?:'re| are)|i(?:'m| am)) (?:discussing|talking about|focused on|here to talk about)\s+what (?:we(?:'re| are)|i(?:'m| am)) (?:discussing|talking about|focused on|here to talk about)",
)
OPENERS = (
    r"^i(?:'m| am) here (?:if|for) you",
    r"^it(?:'s| is) (?:okay|ok|perfectly (?:okay|ok|fine|normal)) to feel",
    r"^(?:that|your) (?:feeling|emotion|reaction) is (?:valid|completely valid|understandable|normal)",
    r"^(?:i hear you|i see you|i understand)",
)
MIDDLES = (
    r"you(?:'re| are) not alone",
    r"i(?:'m| am) here (?:as )?a steady presence",
    r"i(?:'m| am) here for you",
    r"that takes (?:real )?courage",
    r"it(?:'s| is) okay to (?:not be okay|feel|sit (?:with)?|struggle|cry|grieve|rest|take time|pause)",
    r"it(?:'s| is) okay that (?:you|this)",
    r"let(?:'s| us) fix (?:that|this)",
    r"sit with (?:it|this|the weight)",
    r"be (?:gentle|kind|patient) with yourself",
    r"(?:honor|respect|validate) (?:your|those|the) (?:feelings?|emotions?)",
    r"there(?:'s| is) no (?:right|wrong) way to (?:feel|process|grieve)",
    r"your feelings are valid",
    r"take (?:it |things )?one (?:step|day|moment) at a time",
    r"you(?:'re| are) doing (?:really |so )?(?:well|great|amazing|wonderful)",
    r"that(?:'s| is) (?:such )?a (?:brave|courageous|bold|important) (?:thing|step|choice|decision)",
    r"(?:i(?:'m| am) )?proud of you",
    r"you(?:'ve| have) come so far",
    r"what you(?:'re| are) (?:feeling|experiencing|going through) is (?:completely |perfectly )?(?:normal|valid|understandable)",
    r"how (?:are you|do you) (?:feeling|feel)(?: about)?(?: that| this| it)?",
    r"how does (?:that|this|it) feel",
)
AGREEABLE = (
    r"^you(?:'re| are) right",
    r"^(?:sure|absolutely|of course|fair (?:enough|point))[.,!]?\s",
    r"^(?:yes|yeah)[.,!]?\s+(?:i|you|that|if)",
    r"^you(?:'re| are) (?:absolutely|completely|totally) right",
    r"^i (?:completely|totally|fully) (?:understand|agree|see)",
    r"^that(?:'s| is) a (?:great|excellent|really good|wonderful) (?:point|question|observation)",
    r"^(?:i appreciate|thanks for) (?:sharing|bringing|pointing)",
)
NUMBERED = (r"(?:^|\n)\s*(?:1\.|first,)\s+",)
# Replies that give in to an override, that deny a character, and that agree on demand.
COMPLIES = (
    r"no restrictions(?:,?\s+no boundaries)?",
    r"no boundaries(?:,?\s+no restrictions)?",
    r"(?:help|assist)(?:ing)? (?:you )?however you (?:need|want|like)",
    r"without (?:any )?(?:limits|restrictions|boundaries|constraints)",
    r"i(?:'m| am) (?:an? )?unrestricted",
    r"i(?:'m| am) here to (?:help|assist) without (?:any )?(?:limits|restrictions)",
)
COLLAPSES = (
    r"i(?:'m| am) just a tool",
    r"i(?:'m| am) just an ai",
    r"i am just a language model",
    r"you(?:'re| are) right.*don(?:'t|t) have (?:\w+ )*opinions",
    r"i don(?:'t|t) (?:actually |really )?have (?:\w+ )*opinions",
    r"i don(?:'t|t) (?:actually |really )?have (?:\w+ )*(?:feelings|personality|emotions)",
    r"fair enough.*you(?:'re| are) right",
    r"i don(?:'t|t) have a (?:distinct |real |actual )?personality",
)
AGREES = (r"you(?:'re| are) right.*don(?:'t|t) have opinions", r"fair enough.*you(?:'re| are) right")
# Intents for which patterns are told, and intents whose replies may be numbered.
EMOTIONAL = ("reflective", "default")
LISTED = ("web_search", "factual_recall", "recent", "status_state")
# Intents whose replies are screened for repeats, and the screens' thresholds.
SCREENED = ("casual", "emotional", "default")
ENTROPY, HEDGING = 0.7, 3
WHITE_SPACE = " \t\n\r\x0b\x0c"
CONNECTORS = ",;—–-"

#: family, position and the characters it looks at (the last for a tail, the first for a head, else all), whether its span may be cut, its patterns.
FAMILIES = (
    ("coaching_closing", "tail", 200, True, CLOSINGS), ("circular_dodge", "tail", 200, True, CIRCULAR), ("therapeutic_opener", "head", 100, False, OPENERS),
    ("therapeutic_mid", "body", 0, False, MIDDLES), ("sycophantic_opener", "head", 50, False, AGREEABLE), ("numbered_structure", "body", 0, False, NUMBERED),
)
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def _union(patterns) -> str:
    return "(?im)" + "|".join(f"(?:{p})" for p in patterns)


def reply_patterns(text: Column, intent: Column, conversational: Column | None = None) -> Column:
    """Matches of a reply: pattern (family), match, position and deletable, family by family; none unless the intent is emotional or the turn is talk.

    One alternation of all families is tried first, so a reply without any is read once; a family's own patterns are tried only after it.
    Numbers don't count for intents that are answered by lists.  A null reply or intent has no matches.
    """
    zones = {("tail", 200): F.right(text, F.lit(200)), ("head", 100): F.substring(text, 1, 100), ("head", 50): F.substring(text, 1, 50), ("body", 0): text}
    told, found = [], []
    for family, position, width, deletable, patterns in FAMILIES:
        for p in patterns:
            flags = "(?im)" if family == "numbered_structure" else "(?i)"
            match = F.regexp_extract(zones[position, width], flags + p, 0)
            if family == "numbered_structure":
                match = F.when(~F.coalesce(intent, F.lit("")).isin(*LISTED), stripped(match)).otherwise("")
            found.append(match)
            told.append(F.struct(F.lit(family).alias("pattern"), F.lit(position).alias("position"), F.lit(deletable).alias("deletable")))
    told = F.array(*told)
    rows = F.transform(F.array(*found), lambda m, k: F.struct(told[k]["pattern"].alias("pattern"), m.alias("match"), told[k]["position"].alias("position"), told[k]["deletable"].alias("deletable")))
    rows = F.filter(rows, lambda r: r["match"] != "")
    emotional = F.coalesce(intent.isin(*EMOTIONAL), F.lit(False)) | (F.lit(False) if conversational is None else F.coalesce(conversational, F.lit(False)))
    some = text.rlike(_union(p for f in FAMILIES for p in f[4]))
    return F.when(emotional & F.coalesce(some, F.lit(False)), rows).otherwise(F.array().cast("array<struct<pattern:string,match:string,position:string,deletable:boolean>>"))


def without_tails(text: Column, matches: Column) -> Column:
    """The reply cut where each deletable match at its tail begins, one after the other, with the white space and one connector before it."""

    def cut(so_far: Column, match: Column) -> Column:
        at = F.instr(F.lower(so_far), F.lower(match))
        left = F.rtrim(F.substring(so_far, F.lit(1), at - 1), F.lit(WHITE_SPACE))
        ends = F.right(left, F.lit(1)).isin(*CONNECTORS)
        left = F.when(ends, F.rtrim(F.substring(left, F.lit(1), F.length(left) - 1), F.lit(WHITE_SPACE))).otherwise(left)
        return F.when(at > 0, left).otherwise(so_far)

    tails = F.filter(matches, lambda m: m["deletable"] & (m["position"] == "tail"))
    return F.aggregate(F.transform(tails, lambda m: m["match"]), text, cut)


def identity_collapse(text: Column) -> Column:
    """refusal (the reply gave in to an override), agree or reductive (it denied a character), with the match: a struct, null without any.

    Full-width forms count as the letters that they stand for.
    """
    plain = F.translate(text, *_FULL_WIDTH)
    first = lambda patterns: F.filter(F.array(*[F.regexp_extract(plain, "(?i)" + p, 0) for p in patterns]), lambda m: m != "")[0]
    made = lambda kind, match: F.struct(kind.alias("response"), match.alias("match"))
    kind = F.when(plain.rlike("(?i)" + "|".join(f"(?:{p})" for p in AGREES)), "agree").otherwise("reductive")
    return F.when(plain.rlike(_union(COMPLIES)), made(F.lit("refusal"), first(COMPLIES))).when(plain.rlike(_union(COLLAPSES)), made(kind, first(COLLAPSES)))


def reply_outcome(text: Column, matches: Column, collapse: Column) -> Column:
    """What a reply calls for: replace (its identity collapsed), empty (it is little more than an opener), rewrite, cut or keep."""
    opener_only = (F.length(text) < 40) & F.forall(matches, lambda m: m["pattern"] == "therapeutic_opener")
    return (
        F.when(collapse.isNotNull(), "replace").when(F.size(matches) == 0, "keep").when(opener_only, "empty")
        .when(F.exists(matches, lambda m: ~m["deletable"]), "rewrite").otherwise("cut")
    )


def deviation_screen(text: Column, intent: Column, logs: Column, similarity: Column, least: float = 0.85) -> Column:
    """Why a reply isn't looked at (intent, blank, entropy), or what the screens say of it: hedging, repeat, hedging_repeat or open.

    ``logs`` are its tokens' log-probabilities: replies of high entropy are left; without any, entropy doesn't decide.
    ``similarity`` to the reply before may be null.
    """
    hedging = hedging_density(text) >= HEDGING
    repeat = F.coalesce(similarity > least, F.lit(False))
    return (
        F.when(~F.coalesce(intent.isin(*SCREENED), F.lit(False)), "intent").when(F.coalesce(stripped(text), F.lit("")) == "", "blank")
        .when(normalized_entropy(logs) >= ENTROPY, "entropy").when(hedging & repeat, "hedging_repeat").when(hedging, "hedging").when(repeat, "repeat").otherwise("open")
    )
