"""The prompts of the analysis. Each asks for JSON that the operators read (see insights.from_answers, suggestions.from_answers)."""

from __future__ import annotations

from skeinlog.operators.insights import ACTION_HINTS, CATEGORIES
from skeinlog.operators.suggestions import PRIORITIES, TYPES

_INSIGHT = f"""{{"category": one of {", ".join(CATEGORIES)},
 "title": a short name, "description": what happened and why it matters, "confidence": a number from 0 to 1,
 "evidence": up to three of {{"role": "user" or "assistant", "text": a quotation, "messageIndex": its number}},
 "suggestedRule": the rule that would have helped, or null, "actionHint": one of {", ".join(ACTION_HINTS)}}}"""

SINGLE = f"""Read this conversation between a user and a coding assistant. Find what the assistant should have known, where it was
corrected or refused, and what it got wrong more than once. Leave out what the rules below say already.

Rules in force:
{{{{rules}}}}

Tools used:
{{{{usage}}}}

Conversation:
{{{{conversation}}}}

Answer with a JSON array and nothing else; an empty one if there is nothing to say. Each item:
{_INSIGHT}
"""

CROSS = f"""These are findings from several sessions, as JSON. Find what recurs in two sessions or more.

{{{{insights}}}}

Answer with a JSON array and nothing else. Each item:
{_INSIGHT[:-1]},
 "occurrences": for every session, {{"sessionId": its id, "insightId": the finding's id}}}}
"""

SUGGEST = f"""Suggest changes to the rule files so that these findings do not come up again. Prefer to change or merge rules over adding
more of them, and do not repeat what is suggested already.

Rule files:
{{{{rules}}}}

Suggested already:
{{{{existing}}}}

Findings:
{{{{insights}}}}

Answer with a JSON array and nothing else. Each item:
{{"type": one of {", ".join(TYPES)}, "priority": one of {", ".join(PRIORITIES)}, "title": a short name, "rationale": why,
 "targetFile": the file, "targetSection": its heading or null, "content": {{"add": lines or null, "remove": lines or null}},
 "sourceInsightIds": ids of the findings behind it, "skipped": true if a finding needs no change, "skipReason": why then}}
"""

#: One call for a session's findings and the changes that follow from them.
COMBINED = SINGLE.replace(
    "Answer with a JSON array and nothing else; an empty one if there is nothing to say. Each item:",
    "Answer with a JSON object and nothing else: {\"insights\": an array, \"suggestions\": an array, their sourceInsightIds being places in the first, from 0}. Each insight:",
) + "Each suggestion:\n" + SUGGEST[SUGGEST.index('{"type"') :]
