"""Speaker roles, questions and the phrases that open a question session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaker labels, affiliations, titles and phrases of the domain.
OPERATOR = [r"\boperator\b", r"\bconference\s+operator\b", r"\bmoderator\b", r"\bcoordinator\b", r"\bquestion[-\s]?and[-\s]?answer\s+operator\b"]
AFFILIATION = [
    r"\bgoldman\b", r"\bsachs\b", r"\bmorgan\s+stanley\b", r"\bjp\s*morgan\b", r"\bj\.?p\.?\s*morgan\b", r"\bbank\s+of\s+america\b", r"\bbofa\b", r"\bbarclays\b", r"\bcitigroup\b", r"\bciti\b",
    r"\bdeutsche\s+bank\b", r"\bdeutsche\b", r"\bubs\b", r"\bwells\s+fargo\b", r"\bcredit\s+suisse\b", r"\bnomura\b", r"\bhsbc\b", r"\bmacquarie\b", r"\bmizuho\b",
    r"\bjefferies\b", r"\bpiper\s+sandler\b", r"\bstifel\b", r"\brbc\b", r"\bcowen\b", r"\bbaird\b", r"\bevercore\b", r"\bwolfe\s+research\b", r"\bbernstein\b", r"\bwilliam\s+blair\b",
    r"\btruist\b", r"\braymond\s+james\b", r"\bbmo\b", r"\bbtig\b", r"\boppenheimer\b", r"\bneedham\b", r"\bkbw\b", r"\bmoffett\s*nathanson\b", r"\bredburn\b", r"\bguggenheim\b",
    r"\bloop\s+capital\b", r"\bnew\s+street\b", r"\bnorthcoast\b", r"\bglenrock\b", r"\batlantic\s+equities\b", r"\bcanaccord\b", r"\bwedbush\b", r"\bkeybanc\b", r"\bstephens\b",
    r"\bleerink\b", r"\brosenblatt\b", r"\blake\s+street\b", r"\bd\.?\s*a\.?\s+davidson\b", r"\bjanney\b", r"\btelsey\b", r"\bwolfe\b", r"\bscotia\b",
    r"\banalyst\b", r"\bresearch\b", r"\bsecurities\b", r"\badvisors?\b", r"\bassociates\b",
]
TITLE = [
    r"\bceo\b", r"\bcfo\b", r"\bcoo\b", r"\bcto\b", r"\bcio\b", r"\bpresident\b", r"\bchairman\b", r"\bchairwoman\b", r"\bchair\b", r"\bchief\b", r"\bexecutive\b", r"\bofficer\b",
    r"\bdirector\b", r"\bvice\s+president\b", r"\bhead\s+of\b", r"\bsenior\s+vice\b", r"\be\.?v\.?p\.?\b", r"\bs\.?v\.?p\.?\b", r"\btreasurer\b", r"\bcontroller\b", r"\bcomptroller\b",
    r"\bfounder\b", r"\bsecretary\b", r"\bgeneral\s+manager\b", r"\bgeneral\s+counsel\b", r"\bmanaging\s+director\b", r"\binvestor\s+relations\b", r"\b(?:head|vp|dir)\s+(?:of\s+)?ir\b",
]
ANALYST_LABEL = ["unidentified analyst", "analyst", "questioner", "caller"]
QUESTION_START = ["can", "could", "what", "how", "why", "when", "where", "is", "are", "do", "does", "would", "will", "should", "may", "might"]
STRONG_OPENING = [
    r"(?:we\s+will\s+now\s+begin|let'?s\s+begin|we(?:'re|\s+are)\s+now\s+(?:ready\s+to\s+)?(?:begin|open|start|move)).*?(?:question|q\s*&\s*a)",
    r"(?:open|opening)\s+(?:the\s+)?(?:floor|line|call)\s+(?:for|to)\s+questions",
    r"operator\s+instructions",
    r"(?:our\s+)?(?:first|next)\s+question\s+(?:comes?\s+from|is\s+from|is\s+coming|from\s+(?:the\s+)?line|today)",
    r"we(?:'ll|\s+will)\s+take\s+(?:our\s+)?(?:first|next)\s+question",
    r"we(?:'ll|\s+will)\s+now\s+take\s+(?:your|our|any)?\s*questions?",
]
WEAK_OPENING = [
    r"question.{0,10}answer", r"q\s*&\s*a\s+session", r"q\s*&\s*a\s+portion", r"open.*(?:for|to).*questions", r"take.*questions",
    r"we(?:'ll|\s+will)\s+now\s+take\s+(?:your|our|any)?\s*questions?", r"we(?:'re|\s+are)\s+ready\s+for\s+questions?", r"first question", r"over to.*(?:operator|questions)",
]
WELCOME = [
    "welcome to", "welcome everyone", "listen-only mode", "listen only mode", "all participants are in", "conference call", "conference operator",
    "earnings call", "earnings conference", "i would like to welcome", "i would now like to turn", "you may begin", "please go ahead", "will follow the formal presentation",
]
TRANSITION = [
    "move over to q&a", "move to q&a", "move to questions", "open it up for questions", "open the line for questions",
    "begin the q&a", "start the q&a", "ready to start the q&a", "we will now begin the question", "let's move to questions",
]
INTRODUCTION = [
    r"(?:next\s+question|first\s+question|next\s+caller|our\s+(?:next|first|final|last)\s+question).*?(?:comes?\s+from|from|is)\s+([A-Z][a-zA-Z\.\-']+(?:\s+[A-Z][a-zA-Z\.\-']+){0,3})\s+(?:with|at|from|of)\s+(.+?)(?:\.\s|\.?$|\.\s*(?:Please|Your|Go|One))",
    r"(?:question|caller).*?(?:line\s+of|from)\s+([A-Z][a-zA-Z\.\-']+(?:\s+[A-Z][a-zA-Z\.\-']+){0,3})\s+(?:with|at|from|of)\s+(.+?)(?:\.\s|\.?$|\.\s*(?:Please|Your|Go|One))",
    r"(?:next\s+question|first\s+question|next\s+caller|our\s+(?:next|first|final|last)\s+question).*?(?:comes?\s+from|from|is)\s+([A-Z][a-zA-Z\.\-']+(?:\s+[A-Z][a-zA-Z\.\-']+){0,3})(?:\.\s|\.?$|\s*(?:please|go\s+ahead))",
]
# End of fixed values.


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(text: Column | str, patterns: list[str]) -> Column:
    return F.coalesce(_c(text), F.lit("")).rlike("(?i)" + "|".join(patterns))


def holds(text: Column | str, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    found = [low.contains(p) for p in phrases]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def is_operator(speaker: Column | str) -> Column:
    return matches(speaker, OPERATOR)


def role_of(speaker: Column | str) -> Column:
    """operator, analyst, management or unknown from the speaker label alone."""
    firm, title, label = matches(speaker, AFFILIATION), matches(speaker, TITLE), holds(speaker, ANALYST_LABEL)
    return F.when(is_operator(speaker), "operator").when(firm & (~title | label), "analyst").when(title, "management").when(firm | label, "analyst").otherwise("unknown")


def is_question(text: Column | str) -> Column:
    """A question mark early on, or a question word first."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.contains(F.left(text, F.lit(500)), F.lit("?")) | F.lower(F.trim(text)).rlike(f"^({'|'.join(QUESTION_START)}) ")


def introduced_analyst(text: Column | str) -> Column:
    """Name in an operator's introduction, lower case; null if there is none."""
    text = F.coalesce(_c(text), F.lit(""))
    names = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in INTRODUCTION]
    return F.lower(F.regexp_replace(F.trim(F.coalesce(*names)), r"\s+", " "))
