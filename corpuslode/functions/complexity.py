"""How complex a question is, by ordered families of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each family, in their order.
COMPARISON = [
    r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b", r"\bcomparison\b", r"\bdifference\s+between\b", r"\bdiffer(?:s|ent|ence)?\b",
    r"\bhow\s+(?:does|do|is|are)\s+\w+\s+(?:different|compare)", r"\bwhat\s+(?:is|are)\s+the\s+difference",
    r"\bwhich\s+(?:is|should|one)\s+(?:better|preferred|recommended)", r"\bpros\s+and\s+cons\b", r"\btrade-?offs?\b", r"\bchoose\s+between\b",
]
EXPLANATION = [
    r"^what\s+is\s+the\s+purpose\s+of\b", r"^what\s+(?:is|are)\s+(?:a\s+)?(?:the\s+)?(?:role|function|purpose|concept|idea|mechanism)\b",
    r"^explain\b", r"^describe\b", r"^how\s+does\b", r"^how\s+do\b", r"^why\s+(?:does|do|is|are|should|would|can)\b", r"^what\s+happens\s+when\b",
    r"^what\s+(?:is|are)\s+the\s+(?:benefit|advantage|disadvantage|implication|consequence)", r"\bhow\s+(?:does|do)\s+\w+\s+work\b",
    r"\barchitecture\s+of\b", r"\bexplain\s+(?:the|how|why)\b", r"\bdescribe\s+(?:the|how|why)\b",
    r"\bwhat\s+is\s+the\s+(?:kubelet|kube-proxy|etcd|api[\s-]?server|scheduler|controller)", r"\bwhat\s+(?:is|are)\s+(?:the\s+purpose|the\s+role)\b",
    r"^what\s+(?:is|are)\s+(?:a\s+|the\s+)?(?:namespace|pod|service|deployment|statefulset|daemonset|job|cronjob|configmap|secret|ingress|networkpolic|rbac|admission\s+controller|init\s+container|sidecar|operator|crd|custom\s+resource|persistent\s+volume|storage\s+class|node\s+selector|taint|toleration|affinity|finalizer|annotation|label|replica\s*set|pod\s*security)",
]
TROUBLE = [
    r"\btroubleshoot\b", r"\bdebug\b", r"\bdiagnos\b", r"\bfix\b", r"\bresolv\b", r"\bsolv\b", r"\bwhat\s*'?s?\s+wrong\b", r"\bnot\s+working\b",
    r"\bfail(?:s|ed|ing|ure)?\b", r"\berror\b", r"\bcrash\b", r"\bcrashl[o]*p\b", r"\boomkill\b", r"\boom\b", r"\bpending\b.*\bpod\b",
    r"\bpod\b.*\bpending\b", r"\bstuck\b", r"\bhang(?:s|ing)?\b", r"\bwhy\s+(?:is|are|does|do)\s+my\b",
    r"\bhow\s+(?:do\s+i|to)\s+(?:troubleshoot|debug|diagnose|fix|resolve)", r"\bimage\s*pull\s*back\s*off\b", r"\bevict\b",
]
PROCEDURE = [
    r"^how\s+(?:do\s+i|to|can\s+i)\b", r"^steps?\s+to\b", r"^guide\s+to\b", r"^create\b", r"^configure\b", r"^set\s*up\b", r"^install\b", r"^deploy\b",
    r"^upgrade\b", r"\bstep[\s-]by[\s-]step\b",
    r"\bhow\s+(?:do\s+i|to|can\s+i)\s+(?:create|configure|set\s*up|install|deploy|upgrade|delete|remove|update|scale|rollback|roll\s+back)",
]
FACT = [
    r"^what\s+(?:is|are)\s+the\s+(?:default|maximum|minimum|max|min)\b", r"^what\s+(?:command|port|flag|option|parameter|field|annotation|label|version)\b",
    r"^which\s+(?:command|port|flag|option|parameter|field|version)\b", r"^what\s+(?:is|are)\s+the\s+(?:name|type|value|format|syntax)\b",
    r"\bdefault\s+(?:value|port|size|limit|timeout)\b", r"\bwhat\s+(?:flag|command|option)\b", r"\bhow\s+many\b", r"\bhow\s+much\b",
]
FAMILIES = [("multi", COMPARISON), ("complex", EXPLANATION + TROUBLE), ("simple", PROCEDURE + FACT)]
#: A question of no family is simple up to so many words.
SHORT = 6
WARNINGS = ["warning", "caution", "avoid", "never", "don't", "not", "cannot", "should not"]
POSITIVE = ["how to", "recommended", "implement", "setup", "enable", "configure"]


def query_complexity(query: Column) -> Column:
    """simple, complex or multi: the first family with a pattern in the question, else by its length."""
    q = F.trim(F.lower(query))
    out = None
    for name, patterns in FAMILIES:
        hit = q.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return out.when(n <= SHORT, "simple").otherwise("complex")


def negation_score(content: Column) -> Column:
    """2 for each warning word in a text, less 0.5 for each word of advice."""
    held = lambda words: sum((F.contains(F.lower(content), F.lit(w)).cast("int") for w in words), F.lit(0))
    return held(WARNINGS) * 2.0 - held(POSITIVE) * 0.5


def fact_match(fact: Column, text: Column) -> tuple[Column, Column]:
    """(exact, fuzzy): the fact occurs in the text; it does, or each of its two or more words does."""
    f, t = F.lower(fact), F.lower(text)
    own = F.filter(F.split(f, r"\s+"), lambda w: w != "")
    exact = F.contains(t, f)
    return exact, exact | ((F.size(own) >= 2) & F.forall(own, lambda w: F.contains(t, w)))


def level_score(level: Column, confidence: Column) -> Column:
    """A confidence, held within its level's range."""
    middle = F.greatest(F.least(confidence, F.lit(0.79)), F.lit(0.5))
    return F.when(level == "HIGH", F.greatest(confidence, F.lit(0.8))).when(level == "MEDIUM", middle).otherwise(F.least(confidence, F.lit(0.49)))


def position_weight(rank: Column) -> Column:
    """What a grade counts for at a rank; a miss (null) still counts a little."""
    return F.when(rank == 1, 1.0).when(rank <= 3, 0.95).when(rank <= 5, 0.85).otherwise(0.6)
