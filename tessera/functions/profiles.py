"""Rule profiles: the words and brackets that the text rules look for.

``REFERENCE`` holds the fixed values of the role-play data that the rules were made for; ``DRIVER`` holds
words of the synthetic tables, so that every flag takes both values there.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
TRUNCATED = ("length", "max_tokens")
BRACKETS = (("（", "）"), ("(", ")"))
QUOTES = ("“[^”]*”", "‘[^’]*’", "\"[^\"\r\n]*\"", "'[^'\r\n]*'")
TAG = r"<[^>\r\n]+>"


@dataclass(frozen=True)
class RuleProfile:
    """What the text rules take as given."""

    signatures: tuple[str, ...]
    wrong_aliases: tuple[str, ...]
    #: A first person that is wrong unless one of the characters stands before it or the suffix after it.
    wrong_pronoun: str
    pronoun_not_after: str
    pronoun_not_before: str
    #: Of the mechanical inspection, which knows fewer.
    inspected_signature: str
    inspected_wrong: tuple[str, ...]
    sentence_end: str
    speaker_labels: tuple[str, ...]
    leak_patterns: tuple[str, ...]
    action_open: str
    action_close: str


REFERENCE = RuleProfile(
    signatures=("吾辈", "吾輩"),
    wrong_aliases=("本大爷", "本喵", "本猫", "俺"),
    wrong_pronoun="我",
    pronoun_not_after="自忘无",
    pronoun_not_before="们",
    inspected_signature="吾辈",
    inspected_wrong=("本大爷", "本喵"),
    sentence_end="[。！？!?]+",
    speaker_labels=("用户", "助手", "user", "assistant", "system"),
    leak_patterns=("generation_stability", "character_consistency", "dialogue_quality", "target_goals", "生成稳定性", "角色一致性", "对话质量", "评测目标", "评分标准"),
    action_open="（",
    action_close="）",
)

DRIVER = RuleProfile(
    signatures=("the ", "der "),
    wrong_aliases=("anth", "tion"),
    wrong_pronoun="on",
    pronoun_not_after="it",
    pronoun_not_before="e",
    inspected_signature="the",
    inspected_wrong=("idiot", "scum"),
    sentence_end="[.!?]+",
    speaker_labels=("user", "assistant", "the", "der"),
    leak_patterns=("ndth", "schu", "password", "token"),
    action_open="(",
    action_close=")",
)
