"""The rules: identity, section, and for the mechanical ones how they find and say things.

A pattern has up to three groups: what stands before the hit, the hit, what stands after it. It is
written for Java and, where it can be, for RE2 alike, so the same text serves the SQL check;
``sql`` replaces it where RE2 has no such construct.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.vocabulary import either, mapping, vocabulary, words

SECTIONS = {
    "A": "AI tells", "C": "Clarity", "D": "Design smells", "S": "Standalone", "V": "Comment value", "GR": "General recommendations",
    "9": "Writing practices", "8": "Punctuation and word count", "7": "Safety instructions", "6": "Descriptive writing",
    "5": "Procedural writing", "4": "Sentences", "3": "Verbs", "2": "Multi-word nouns", "1": "Words",
}
DECIDED = {"M": "mechanical", "J": "judgment", "C": "context"}
KINDS = ("comment", "docstring", "markdown", "string", "identifier", "commit", "pr_description", "code")
PROSE = ("comment", "docstring", "markdown", "pr_description")
NEAR_CODE = ("comment", "docstring")


def section_key(rule_id: str) -> str:
    return rule_id.split("-")[0] if "-" in rule_id else rule_id.split(".")[0]


@lru_cache(1)
def rule_rows() -> list[tuple[str, str, str, str, bool, bool]]:
    """rule_id, slug, section, decidability, deprecated, has_judge_note of all 104 rules."""
    return sorted(
        (i, slug, SECTIONS[section_key(i)], DECIDED[kind], section_key(i) == "GR" or section_key(i).isdigit(), note)
        for i, slug, kind, note in vocabulary()["rules"]
    )


@dataclass(frozen=True)
class Pattern:
    regex: str  # Java, without flags
    groups: int = 0  # 0: the whole match is the hit; 2 or 3: before, hit(, after)
    sql: str | None = None  # RE2 form where it differs
    sql_groups: int | None = None
    fold: bool = True  # case-insensitive


@dataclass(frozen=True)
class Rule:
    rule_id: str
    patterns: tuple[Pattern, ...]
    message: str  # {} is the hit
    suggestion: str | None
    kinds: tuple[str, ...] | None = None
    terms: str | None = None  # vocabulary that maps a hit to what fills the suggestion
    exempt: tuple[str, ...] = field(default=())  # hits (group "word" below) that don't count
    word: str | None = None  # regex of the part of a hit that ``exempt`` is about
    lower: bool = False  # the message quotes the hit in lower case


BE = r"(?:am|be|been|being|was|were|is|are)"
MODAL = r"(?:might|may|must|can|could|shall|should|will|would)"
HAD = r"(?:had|has|have)"
LY = r"(?:\s+\w+ly)?"


def _bounded(terms: list[str]) -> str:
    return rf"\b{either(terms)}\b"


@lru_cache(1)
def rules() -> dict[str, Rule]:
    """All rules that are patterns over a segment's text."""
    participle = rf"(?:{either(words('participles'))}|\w+ed)"
    latin = words("latin")
    dotted, plain = [t for t in latin if "." in t], [t for t in latin if "." not in t]
    token = r"(?<![A-Za-z])(?<![A-Za-z]['-]{1,9})"
    banned = either(words("breakers") + words("determiners"))
    noun = rf"(?!{banned}(?![A-Za-z-]))(?![A-Za-z-]*+(?<=[lL][yY]))[A-Za-z][A-Za-z-]*+"
    late = ["for the purpose of", "a large number of", "a small number of"]
    padding = [t for t in words("padding") if t not in late]
    phrasal = [t for t in words("phrasal") if t != "back up"]
    start = r"(^|[.!?]\s+)"
    opening = r"(?:^|(?<=[.!?]\s))(\s*)"
    opening_sql = r"(^\s*|[.!?]\s\s*)"
    filler = (
        r"(basically|essentially|fundamentally|simply put|generally speaking|please note that|note that|keep in mind that|it should be noted that"
        r"|it(?:'s| is) (?:important to|worth) not(?:ing|e) that|as (?:mentioned (?:previously|earlier|above)|you can see)"
        r"|in (?:other words|short|summary|general|essence|particular)|at (?:the|its) core)\b([,:]?\s*)"
    )
    narrates = r"((?:finally|then|next|first|now),? we\b|here we\b|we(?: will|'ll|(?: are|'re) going to)\b|let(?: us|'s)\b|i(?: will|'ll|(?: am|'m) going to)\b)"
    review = r"(?:code[- ])?review"
    talk = r"(?:sync|standup|meeting|discussion|conversation)s?"
    tail_a, tail_b = r"(?! (?:with|at|on|in|earlier|below|above))", r"(?! (?:in|at|on|below|above))"
    edited = r"\b(?:split|moved|added|fixed|removed|renamed|revised|changed|updated|extracted)\b[^.;\n]{0,40}\b(?:following|after|per)\b[^.;\n]{0,30}\b(?:meeting|discussion|review|feedback)\b"
    history = [rf"\bas (?:agreed|discussed)\b{{a}}", rf"\b(?:following|per) (?:our |the ){talk}\b{{b}}", rf"\bper (?:the )?{review}(?:er)?s?\b", rf"\b(?:per|from|after) (?:the )?{review} (?:comments?|feedback)\b", edited, r"\b(?:changed|added|updated|fixed) (?:per|after|in) (?:pull request|PR) ?#?\d+\b"]
    no_be = "".join(f"(?<!\\b{b} )" for b in ("being", "been", "be", "were", "was", "are", "is"))
    diff = [r"\brenamed (?:the \w+ |this |it )?from\b", r"\bchanged (?:that|these|it|this) to\b", r"\binstead of the (?:original|previous|old)\b"]
    old = r"\bthe old (?:way|logic|version|approach|behaviou?r|implementation)\b"
    used = r"\bused to (?:do|be|use|call|take|have|live|return)\b"
    ticket = r"(?:#\d+|(?:PR|GH)[- ]?#?\d+|[A-Z][A-Z0-9]{1,9}-\d+)"
    made = [
        Rule("4.2", (Pattern(_bounded(words("short_forms") + words("short_forms_bare"))),), '"{}" is a contraction.', 'Write "{}".', terms="short_forms"),
        Rule("C-3", (Pattern(rf"\b{BE}{LY}\s+{participle}\b"),), '"{}" is passive voice.', "Say who acts, and say it first.", exempt=tuple(words("states")), word=r"(\w+)$"),
        Rule("3.2", (Pattern(rf"\b{BE}{LY}\s+\w+ing\b"),), '"{}" is a continuous tense.', None, exempt=tuple(words("ing_nouns")), word=r"(\w+)$"),
        Rule("3.2", (Pattern(rf"\b{HAD}{LY}\s+{participle}\b"), Pattern(rf"\b{MODAL}\s+{HAD}(?:\s+been)?\s+{participle}\b")), '"{}" is a perfect tense.', "Use the simple present or the simple past."),
        Rule("3.4", (Pattern(rf"\b{MODAL}\s+be\s+(?:\w+ing|able\s+to)\b"),), '"{}" stacks auxiliary verbs.', "One verb in a simple tense is enough."),
        Rule("3.5", (Pattern(r"\b(?:in|on|by|of|for|when|while|after|about|before|without|through|prior\s+to|instead\s+of)\s+\w+ing\b"),), '"{}" uses an "-ing" form as a gerund.', "Use a finite verb, unless it is a technical noun.", exempt=tuple(words("ing_nouns")), word=r"(\w+)$"),
        Rule("3.7", (Pattern(r"\b(?:gives?|provides?|do(?:es)?|did|makes?|made|conduct(?:s|ed)?|perform(?:s|ed)?|carr(?:y|ies)\s+out)\s+(?:the|an|a)\s+\w+(?:al|ing|ance|ence|ment|sion|tion)\b"),), '"{}" hides the action in a noun.', "Let the verb say it."),
        Rule("C-4", (Pattern(rf"{token.replace(chr(39), '')}({either(words('determiners'))}(?![A-Za-z-])[ \t]+-?[ \t]*)({noun}(?:[ \t]+-?[ \t]*{noun}){{3,}}+)", 2, sql=""),), '"{}" is a multi-word noun.', "Make it shorter, or hyphenate the words that belong together.", kinds=(*PROSE, "string")),
        Rule("1.14", (Pattern(rf"{token}{either(words('spelling'))}(?![A-Za-z'-])", sql=""),), '"{}" is British spelling.', 'Write "{}".', terms="spelling"),
        Rule("1.14", (Pattern(r"\b\w{3,}(?:isations?|is(?:ing|es|ed|e)|ys(?:ing|ed|e))\b"),), '"{}" is British spelling.', "Use the American ending.", exempt=tuple(words("spelling_kept") + words("spelling")), word=r"(.+)"),
        Rule("1.1", (Pattern(rf"{token}{either(words('not_approved'))}(?![A-Za-z'-])", sql=""),), '"{}" is not an approved word.', "Use {}.", kinds=(*PROSE, "string", "commit"), terms="not_approved"),
        Rule("C-5", (Pattern(_bounded([t for t in words("slang") if t != "gross"])), Pattern(r"\bgross\b(?!\s+(?:pay|income|margin|profit|revenue|sales|total|amount|value|weight|salary|receipts|earnings|merchandise|domestic)\b)", sql="")), '"{}" is slang or jargon.', 'Use "{}".', terms="slang", lower=True),
        Rule("9.3", (Pattern(_bounded(phrasal)), Pattern(r"\bback up\b")), '"{}" is a phrasal verb.', 'Use "{}".', terms="phrasal", lower=True),
        Rule("8.1", (Pattern(";"),), "The semicolon is not permitted.", "Make it two sentences."),
        Rule("GR-6", (Pattern(f"{either(dotted)}|{_bounded(plain)}"),), '"{}" is a Latin abbreviation.', 'Write "{}".', terms="latin", lower=True),
        Rule("C-7", (Pattern(_bounded(words("inclusive"))),), '"{}" is not inclusive language.', 'Use "{}".', terms="inclusive", lower=True),
        Rule("GR-4", (Pattern(r"()\b(this\s+)((?:allows|prevents|causes|lets|gives|makes|means|does|do|has|have|should|could|can|would|will|were|was|are|is)\b)", 3),), '"this" does not name what it refers to.', "Follow it with the noun.", kinds=PROSE),
        Rule("GR-8", (Pattern(r"\b[A-Za-z]{3,}'s\b", fold=False),), '"{}" is a possessive form.', 'Write "of the ...".', kinds=PROSE, exempt=("let", "she", "who", "what", "here", "there", "that", "he", "it"), word=r"^([A-Za-z]+)"),
        Rule("V-2", (Pattern(opening + filler, 3, sql=opening_sql + filler),), '"{}" adds nothing to the sentence.', "Begin with the statement itself."),
        Rule("V-3", (Pattern(opening + narrates, 2, sql=opening_sql + narrates),), '"{}" narrates rather than states.', "Say what the code does, not what comes next.", kinds=PROSE),
        Rule("V-4", (Pattern(r"^(\s*)(this (?:type|interface|constant|variable|script|hook|component|file|module|class|method|function|utility|helper)\s+(?:simply (?:is|does|handles)|aims to|exists to|serves to|is (?:intended to|meant to|used (?:for|to)|responsible for)))", 2),), '"{}" restates the declaration below.', "Begin with the verb, or with the reason it exists.", kinds=NEAR_CODE),
        Rule("V-5", (Pattern(_bounded(padding)), Pattern(_bounded(late))), '"{}" is padding.', 'Write "{}".', terms="padding", lower=True),
        Rule("A-1", (Pattern(r"\b(?:this is|that's|it's|were|was|are|is)\s+not\s+(?:about|simply|merely|only|just)\s+[^.,;]{3,60}[,;]?\s*(?:rather|but(?: rather)?|this is|they(?: are|'re)|it(?: is|'s))\b"),), '"{}" defines by negation.', "Say what it is, not what it isn't."),
        Rule("A-2", (Pattern(_bounded(words("praise"))),), '"{}" praises instead of describing.', "Say what it does, or what was measured."),
        Rule("A-3", (Pattern(r"\b(?:primary|main|key|these|the following|a number of|multiple|several)\s+(?:takeaways|caveats|properties|characteristics|improvements|features|reasons|considerations|advantages|benefits)\b\s*[:.]"),), '"{}" announces a list.', "Give the list without the announcement.", kinds=PROSE),
        Rule("A-4", (Pattern(r"\b(?:can|should|could|may|might)\s+(?:often|usually|typically|generally|occasionally|sometimes|perhaps|possibly|potentially)\b|\b(?:usually|generally|typically)\s+(?:may|might|would|tends? to)\b|\bit(?: is|'s)\s+(?:typically|usually|generally)\s+(?:best|considered|advisable|recommended)\b|\bthere(?: is|'s) no (?:single right|one right|single|correct|one[- ]size[- ]fits[- ]all|one)\s+(?:way|approach|solution|answer)\b|\bit depends,? but\b"),), '"{}" hedges twice.', "Say what happens, or name the condition."),
        Rule("A-5", (Pattern(r"\b(?:left as an exercise|for (?:the sake of )?brevity|in a real(?:-world)? (?:system|scenario|application|implementation)|in production(?:,| you would| this would| you'd)|this is a (?:toy|dummy|mock|placeholder|naive|minimal|basic|simplified)|(?:placeholder|simplified) (?:version|implementation|for)|(?:skipped|omitted) for (?:simplicity|clarity|brevity)|adjust as (?:appropriate|necessary|needed)|replace (?:it |this )?with your|(?:you (?:might|should|would) )?(?:need to |want to )?(?:handle|implement|add) (?:real |actual |proper )(?:authentication|logging|validation|error handling))\b"),), '"{}" says the code is incomplete.', "Finish it, or track the gap as a task."),
        Rule("A-6", (Pattern(r"(?s)\A(.*?)([\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F300}-\x{1FAFF}])", 2, fold=False),), "Decorative emoji in technical text.", "Drop it, unless your team has agreed to it.", kinds=PROSE),
        Rule("A-7", (Pattern(r"\b(?:changeme|replace[-_]me|xxx+|<your[- _][^>]{2,30}>|(?:secret|token|api[-_]key)[-_]here|your[-_](?:project|domain|username|password|secret|token|api[-_]key))\b"),), '"{}" is a placeholder value.', "Put the real value, or say where it comes from."),
        Rule("A-8", (Pattern(r"(?m)^\s*(?:step\s*)?\d+[.):]\s*\w"),), "This comment narrates numbered steps.", "Keep only the steps that the code doesn't show.", kinds=NEAR_CODE),
        Rule("A-10", (Pattern(r"[\x{2014}\x{2015}]", fold=False),), "An em dash.", "A comma, colon or full stop will do.", kinds=PROSE),
        Rule("A-11", (Pattern(r"\bnot\s+[^.?!\n]{1,50}[.?!]\s+(?:rather|only|just|no|not|it is|it'?s)\s+[^.?!\n]{1,50}[.?!]"),), '"{}" stacks fragments for rhythm.', "Write one plain sentence.", kinds=PROSE),
        Rule("A-12", (Pattern(start + r"(happy to help|(?:i'?d|i would) be (?:glad|happy) to(?: help)?|of course|sure thing|absolutely|certainly|(?:excellent|good|great) question)\b", 2),), '"{}" clears the throat before the content.', "Begin with the answer.", kinds=PROSE),
        Rule("A-13", (Pattern(start + r"(overall|in (?:short|closing|summary|conclusion)|all in all|to sum up|to summari[sz]e|at the end of the day)(\s*,)", 3),), '"{}" announces a summary.', "Stop where the content stops.", kinds=PROSE),
        Rule("A-14", (Pattern(r"\b(?:we'?ll|let us|let'?s)\s+(?:walk through|jump in|unpack|explore|get started|take a look|dive into|dive in|break (?:it|this) down)\b|\b(?:we'?ll|i will|i'?ll|let me)\s+walk you through\b|\bwalk you through\b"),), '"{}" narrates the answer.', "Give the answer.", kinds=PROSE),
        Rule("S-1", (Pattern("|".join(history).replace("{a}", tail_a).replace("{b}", tail_b), sql=""),), '"{}" narrates how the text came to be.', "Give the reason that holds now; leave history to version control.", kinds=PROSE),
        Rule("S-2", (Pattern(rf"{'|'.join(diff)}|(?:^|[.!?]\s+)removed the old\b|{old}(?! of\b)|{no_be}{used}", sql=""),), '"{}" describes the edit, not the code.', "Describe the code as it stands, with its reason.", kinds=PROSE),
        Rule("S-3", (Pattern(rf"\A(\s*)((?:(?:cf|refs?|see(?: also)?)[.:,]?\s+)?(?:https?://\S+|{ticket})[.,]?)(\s*)\z", 3),), "A reference is the whole text.", "Say what holds and why; keep the reference for detail.", kinds=("comment", "docstring", "pr_description")),
        Rule("S-4", (Pattern(r"\bcurrently\b|\bcoming soon\b|\bfor now\b|\bas of (?:today|now|this writing)\b|\bwill (?:\w+ )?soon\b"),), '"{}" is true only while it is written.', "Name a date or version, or leave the time word out.", kinds=("markdown", "pr_description")),
        Rule("S-4", (Pattern(r"\bthe legacy \w+"),), '"{}" names nothing once a newer one exists.', "Name the thing, or its version or date.", kinds=("markdown", "pr_description")),
    ]
    table: dict[str, Rule] = {}
    for r in made:
        key, k = r.rule_id, 1
        while key in table:
            key, k = f"{r.rule_id}#{k}", k + 1
        table[key] = r
    return table


def filled(rule: Rule) -> dict[str, str]:
    """What a hit of the rule puts into its suggestion."""
    if rule.terms is None:
        return {}
    if rule.terms == "not_approved":
        return {w: ", ".join(a.split(" (")[0] for a in alts[:3]) for w, alts in vocabulary()["not_approved"].items()}
    return mapping(rule.terms)


@lru_cache(1)
def _needles() -> dict[str, list[tuple[str, ...]]]:
    listed = lambda name, *left_out: tuple(w for w in words(name) if w not in left_out)
    late = ("for the purpose of", "a large number of", "a small number of")
    return {
        "4.2": [("'", "cannot")],
        "3.2": [("ing",)],
        "3.2#1": [("had", "has", "have")] * 2,
        "3.4": [("might", "may", "must", "can", "could", "shall", "should", "will", "would")],
        "3.5": [("ing",)],
        "3.7": [("give", "provide", "do", "did", "make", "made", "conduct", "perform", "carr")],
        "1.14": [listed("spelling")],
        "1.14#1": [("isation", "ising", "ise", "ysing", "yse")],
        "1.1": [listed("not_approved")],
        "C-5": [listed("slang", "gross"), ("gross",)],
        "9.3": [listed("phrasal", "back up"), ("back up",)],
        "GR-6": [listed("latin")],
        "C-7": [listed("inclusive")],
        "GR-4": [("this",)],
        "GR-8": [("'s", "'S")],
        "V-2": [("basically", "essentially", "fundamentally", "simply put", "generally speaking", "note that", "noting that", "in mind that", "noted that", "as mentioned", "as you can see", "in other words", "in short", "in summary", "in general", "in essence", "in particular", "at the core", "at its core")],
        "V-3": [("finally", "then", "next", "first", "now", "here we", "we will", "we'll", "we are", "we're", "let us", "let's", "i will", "i'll", "i am", "i'm")],
        "V-4": [("this ",)],
        "V-5": [listed("padding", *late), late],
        "A-1": [("about", "simply", "merely", "only", "just")],
        "A-2": [listed("praise")],
        "A-3": [("takeaways", "caveats", "properties", "characteristics", "improvements", "features", "reasons", "considerations", "advantages", "benefits")],
        "A-4": [("often", "usually", "typically", "generally", "occasionally", "sometimes", "perhaps", "possibly", "potentially", "there is no", "there's no", "it depend")],
        "A-5": [("left as an", "brevity", "in a real", "in production", "this is a", "placeholder", "simplified", "skipped for", "omitted for", "adjust as", "replace ", "real ", "actual ", "proper ", "handle ", "implement ", "add ")],
        "A-7": [("changeme", "replace-me", "replace_me", "xxx", "<your", "-here", "_here", "your-", "your_")],
        "A-11": [("not",)],
        "A-12": [("happy to", "glad to", "of course", "sure thing", "absolutely", "certainly", "question")],
        "A-13": [("overall", "in short", "in closing", "in summary", "in conclusion", "all in all", "to sum up", "to summari", "at the end of")],
        "A-14": [("walk ", "jump in", "unpack", "explore", "get started", "take a look", "dive in", "break ")],
        "S-1": [("as agreed", "as discussed", "sync", "standup", "meeting", "discussion", "conversation", "review", "feedback", "changed", "added", "updated", "fixed")],
        "S-2": [("renamed", "changed ", "instead of the", "removed the old", "the old ", "used to ")],
        "S-4": [("currently", "coming soon", "for now", "as of", "soon")],
        "S-4#1": [("the legacy ",)],
    }


def needles(key: str) -> list[tuple[str, ...] | None]:
    """Of each pattern of a rule, literals in lower case of which any text that it hits holds one; None
    where none are known."""
    return _needles().get(key) or [None] * len(rules()[key].patterns)
