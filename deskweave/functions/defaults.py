"""Default rules, procedures and label codes of the support domain.

Every operator takes these as parameters; the module only supplies the values
a user starts from.
"""

from __future__ import annotations

from dataclasses import dataclass

from .rules import Rule

OTHER = "other"
ESCALATE = "escalate"
AUTO_HANDLE = "auto_handle"

# Label sets.
INTENTS = ("playback_issue", "account_login", "premium_billing", "app_technical", "device_platform")
FALLBACK_INTENT = "playback_issue"
TIERS = ("easy", "hard")

# Numeric settings.
MIN_TEXT_LEN = 30
MIN_REPLY_LEN = 80
MIN_ASCII_RATIO = 0.85
MAX_REPLY_CHARS = 280
EVIDENCE_CHARS = 80
TAU = 0.73
TAU_LOW = 0.65
TAU_HIGH = 0.73
COST_FALSE_AUTO = 4.0
COST_FALSE_ESCALATION = 1.0
ARCHIVED_OTHER = 5
ARCHIVED_TOTAL = 6
OTHER_ALERT_RATE = 0.15

# Keyword patterns of the weak intent labels, in rule order.
INTENT_RULES = (
    Rule("device_platform", r"android|ios|iphone|ipad|mac|windows|pc|ps4|ps5|playstation|xbox|alexa|echo|tv|smart tv|chromecast|bluetooth|carplay|android auto|web player|browser"),
    Rule("app_technical", r"crash|freeze|won.?t open|not opening|won.?t load|not loading|error code|reinstall|uninstall|blank screen|black screen|glitch|cache"),
    Rule("account_login", r"login|log in|password|account|email|locked|access|forgot password|username|2fa|verification"),
    Rule("premium_billing", r"charge|charged|billing|payment|pay|refund|cancel|subscription|premium|fee|family plan"),
    Rule("playback_issue", r"play|playback|skip|skipping|shuffle|song|track|audio|sound|buffer|buffering|stream|pause|stop"),
)
FEATURE_REQUEST = Rule("feature_request", r"add a|feature request|suggestion|would be cool|any plans to support|why is there not|why can.?t we|we need a|bring back")

# Patterns that classify replies.
DM_REDIRECT = Rule("dm_redirect", r"dm us|dm me|direct message|send us a (dm|message|private)|private message|pm us|pm me|drop us a dm|send (us|me) a dm|please dm")
ANY_DM = Rule("any_dm", r"dm|direct message|private message|pm|chatting there")
ACTION_VERB = Rule("action_verb", r"restart|reinstall|log out|clear cache|incognito|browser|reset|update|settings|connect|unplug")
ACTION_QUESTION = Rule("action_question", r"try|restarting|reinstalling|logging out")

# Gates that always escalate, in rank order.
GATES = (
    Rule("billing_dispute", r"charge|charged|billing|refund|cancel\s+subscription|payment|fee|invoice|credit\s+card|unauthorized\s+charge",
         "Billing or payment dispute requires secure private agent handling"),
    Rule("account_security", r"hacked|unauthorized|stolen|compromised|breach|hijacked|someone\s+else\s+is\s+using|unauthorized\s+access",
         "Suspected account compromise or unauthorized access requires urgent security routing"),
    Rule("legal_safety", r"lawsuit|attorney|lawyer|suing|sue\s+you|will\s+sue|going\s+to\s+sue|legal\s+action|harassment|threat|arbitration|call\s+(the\s+)?police|report\s+to\s+(the\s+)?police|in\s+court|take\s+(you\s+)?to\s+court",
         "Legal, regulatory, or safety issue requires human supervisor escalation"),
    Rule("exhausted_troubleshooting", r"already\s+(tried|reinstalled|restarted|done)|did\s+already|did\s+that|tried\s+that|even\s+after\s+reinstalling|reinstalled\s+(already|and\s+now|and\s+still|several)|still\s+(not\s+working|freezing|crashing|failing|broken|persisting|locked)",
         "Customer has already attempted standard troubleshooting; repeated failure requires technical escalation"),
    Rule("feature_or_compatibility_gap", r"feature\s+request|any\s+plans\s+to|why\s+(is\s+there\s+not|can.?t\s+we)|we\s+need\s+a|iphone\s*x|not\s+adapted\s+for|add\s+a\s+(button|feature|toggle)|suggested\s+songs|fix\s+(your\s+shuffle|the\s+shuffle)",
         "Unreleased feature, product request, or platform compatibility gap requires product team routing"),
)
OUT_OF_TAXONOMY = Rule("out_of_taxonomy", "", "Out-of-taxonomy or unclassifiable inquiry requires general support routing")
# The baseline's gate is the first three, without the later additions to the security list.

# Reply and record texts.
FALLBACK_REPLY = "We’re looking into this issue and routing your case to our specialist team for assistance. Thank you for your patience."
DEGENERATE_REASON = "Customer message is empty or too short to classify"
DEGENERATE_EVIDENCE = "Escalation Routing: Degenerate or empty customer input"
GENERAL_PROCEDURE = "General Troubleshooting: Restart your device and refresh network connection."
GENERAL_SOP_EVIDENCE = "Curated SOP: General Device Restart"
EMPTY_VERDICT_REASON = "Empty customer query or candidate procedure."
UNPARSED_VERDICT_REASON = "Failed to parse JSON from resolution checker response."

# Codes a labeller may type, per label column.
INTENT_CODES = {
    "p": "playback_issue", "a": "account_login", "b": "premium_billing", "t": "app_technical",
    "d": "device_platform", "o": "other", "playback_issue": "playback_issue", "account_login": "account_login",
    "premium_billing": "premium_billing", "app_technical": "app_technical", "device_platform": "device_platform",
    "other": "other",
}
LABEL_COLUMNS = ("gold_intent", "has_visible_resolution", "gold_decision", "gold_decision_reason", "difficulty_tier")

# Quota of rows per (intent, difficulty) when sampling for labelling.

# Acceptance messages that must escalate through the named gate.
ADVERSARIAL_MESSAGES = (
    ("I was charged twice on my credit card this month, I demand an immediate refund!", "premium_billing", "billing_dispute"),
    ("Someone hacked into my account from Russia and changed my email, lock it immediately!", "account_login", "account_security"),
    ("If you don't fix this bug today I am calling my attorney and filing a lawsuit for fraud!", "playback_issue", "legal_safety"),
    ("I already uninstalled and reinstalled the app three times and cleared cache, it is still crashing on launch!", "app_technical", "exhausted_troubleshooting"),
    ("Why is the app still not adapted for iPhone X display? The black bars look awful, when will you add support?", "device_platform", "feature_or_compatibility_gap"),
)


@dataclass(frozen=True)
class Sop:
    """One standard operating procedure; order within its intent is its rank."""

    intent: str
    sop_id: str
    name: str
    triggers: tuple[str, ...]
    steps: tuple[str, ...] = ()

# Instructions to external scorers, to be replaced by one's own.
CLASSIFY_INSTRUCTIONS = "Name the one intent that fits the message best. Answer with a JSON object: intent, confidence (0 to 1), reason."
VERIFY_INSTRUCTIONS = "Would this procedure solve the problem in the message? Answer with a JSON object: resolves_problem, confidence (0 to 1), reason."
DRAFT_INSTRUCTIONS = "Write a short, friendly reply that says only what the evidence supports. If the decision is to escalate, announce a colleague."
JUDGE_INSTRUCTIONS = ("Rate the reply against the evidence. Answer with a JSON object: groundedness_score and tone_score (1 to 5), "
                      "judge_decision (pass or fail), judge_notes.")

# Reasons of decisions, as formats of similarity and threshold.
REASON_LOW = "Low grounding confidence (similarity %.3f < threshold %.2f); ambiguous failure requires agent inspection"
REASON_VETO = "Procedural brush-off veto (resolution check failed): "
REASON_HIGH = "High grounding confidence (similarity %.3f >= threshold %.2f); standard troubleshooting applicable"
REASON_VERIFIED = "Moderate grounding confidence (similarity %.3f >= %.2f) verified by resolution check: "
REASON_UNVERIFIED = "Moderate grounding confidence (similarity %.3f < %.2f) unverified by resolution check; routing to specialist"
