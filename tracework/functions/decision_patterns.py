"""Patterns of decision exchanges; ASCII word boundaries, Java's dialect."""

from __future__ import annotations

from .patterns import ascii_word

# Windows, limits, prefixes and patterns that results depend on.

RESPONSE_WINDOW, THINKING_WINDOW, NOVEL_WORDS, BATCH_SIZE, PROACTIVE_WORDS = 3, 5, 3, 20, 20
MAX_EXCHANGE, MAX_PROMPT_SIDE = 10_000, 2_000
CONTINUATION, PLAN_PASTE = "This session is being continued", "Implement the following plan"
NO_CONTEXT = "[Proactive insight — no surrounding agent context]"

REVERSAL = "(?i)" + ascii_word(r"actually|no|wait|scratch that|undo|revert|go back|different approach|instead|never mind")
OPTION_REFERENCES = tuple(
    "(?i)" + ascii_word(p)
    for p in (
        r"(?:option|approach|alternative|choice)\s*(?:[A-C]|\d)",
        r"go\s+with\s+(?:option|approach|#?\s*\d|[A-C])",
        r"(?:the\s+)?(?:first|second|third|last)\s+(?:option|approach|one)",
        r"let'?s?\s+(?:do|go|try)\s+(?:option|approach|#?\s*\d|[A-C])",
        r"(?:prefer|like|pick|choose)\s+(?:option|approach)?\s*(?:\d|[A-C])",
    )
)
AMPLIFICATIONS = tuple(
    "(?i)" + ascii_word(p)
    for p in (
        r"(?:major|key|great|important|critical)\s+(?:insight|point|observation|suggestion)",
        r"fundamentally\s+(?:different|change|better|rethink)",
        r"(?:game\s+changer|breakthrough|paradigm)",
        r"(?:you'?re?\s+right|excellent\s+(?:point|suggestion|idea)|this\s+changes)",
        r"(?:this\s+is\s+(?:much\s+)?better|much\s+cleaner|significantly\s+(?:improve|better|cleaner))",
        r"(?:hadn'?t?\s+(?:considered|thought)|never\s+(?:considered|occurred))",
        r"(?:completely|entirely|totally)\s+different\s+(?:task|approach|direction|problem|framing)",
        r"(?:core|central|fundamental)\s+(?:insight|realization|observation)",
        r"fundamental\s+(?:rearchitecture|reimagining|redesign|rebuild|rewrite|rethink|shift)",
        r"user(?:'s|s)?\s+(?:core|key|main|primary|central)\s+(?:insight|point|ask|request|concern)",
    )
)
REFRAMES = tuple(
    "(?i)" + ascii_word(p)
    for p in (
        r"(?:instead\s+of|shift\s+to|the\s+real\s+(?:issue|problem|question)\s+is)",
        r"(?:rethink|fundamentally|paradigm|categorically\s+different)",
        r"(?:the\s+whole\s+approach|what\s+if\s+we|completely\s+different)",
        r"(?:we\s+should\s+(?:actually|really)|the\s+better\s+way|forget\s+(?:that|this))",
    )
)
DOMAINS = {
    "architecture": r"(?i)service|model|controller|pattern|layer|schema|migration|database|api|endpoint|module|class|concern|interface",
    "debugging": r"(?i)error|bug|fix|broken|failing|exception|debug|root cause|stack trace|crash",
    "scope": r"(?i)scope|feature|priority|defer|cut|mvp|ship|phase|v1|v2|later|backlog",
    "quality": r"(?i)test|spec|coverage|refactor|validation|security|lint|type|safety",
    "product": r"(?i)user|customer|ux|ui|experience|flow|onboarding|design|layout",
    "tooling": r"(?i)ci|cd|deploy|docker|config|dependency|build|pipeline|infra",
}
ONE_WAY = r"(?id)migration|schema|database|deploy|production|api.*contract|public.*interface|delete.*data|breaking.*change"
REVERSIBLE = r"(?i)config|env|style|format|lint|rename|variable|comment|log"
LONG_WORD = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{4,}(?![A-Za-z0-9_])"
RATIONALE = r"(?i)because|reason|since|given that"

FENCE = r"```[A-Za-z0-9_]*\n[\s\S]*?```"
INDENTED = (
    r"(?md)^[ \t]{2,}(?:def |class |module |end$|if |unless |do$|do |require |include |extend |attr_|private|protected|public|return |raise |rescue "
    r"|begin$|ensure$|yield|puts |print |const |let |var |function |import |export |from |=>|->|\{|\}|</|/>)"
)
LONG_INLINE = r"`(?:[^`\s]{10,}|(?=[^`]*[A-Z_:.#/(){}\[\]<>=+])[^`]{10,})`"
SHORT_IDENTIFIER = r"`(?=[\w:.#]*[A-Z_])[\w:.#]+`"
PATHS = (
    r"(?md)(?:^|[\s(\[{,:;])(?:/[\w\-./]+|[\w\-]+(?:/[\w\-.]+)*"
    r"\.(?:rb|rake|ru|gemspec|py|js|ts|jsx|tsx|go|rs|java|cpp|c|h|css|html|erb|yml|yaml|json|toml|sql|sh|bash))"
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
COLLAPSE = r"(\[\w*\s*code[^\]]*\]\s*){2,}"

SIGNIFICANCE = {"strategic_redirect": "strategic", "product_insight": "strategic", "technical_catch": "moderate", "option_selection": "tactical"}
