"""Rule pack: what is specific to a kind of paper, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RulePack:
    """Rules that the extraction, segmentation and grading operators take as a parameter."""

    # Sections in the order of a paper, and the question numbers each has.
    order: tuple[str, ...] = ("reading_a", "reading_b", "reading_c", "reading_d", "gap_filling", "cloze", "grammar", "practical_writing", "continuation_writing")
    ranges: dict[str, tuple[int, int]] = field(
        default_factory=lambda: {"reading_a": (21, 23), "reading_b": (24, 27), "reading_c": (28, 31), "reading_d": (32, 35), "gap_filling": (36, 40), "cloze": (41, 55), "grammar": (56, 65)}
    )
    # What opens a section, tried in the order of the sections.
    openings: dict[str, str] = field(
        default_factory=lambda: {
            "reading_a": r"^\s*(?:阅读理解|第一节|阅读)\s*A\s*$|^\s*A\s*$",
            "reading_b": r"^\s*B\s*$",
            "reading_c": r"^\s*C\s*$",
            "reading_d": r"^\s*D\s*$",
            "gap_filling": r"七选五|选五|根据短文内容.*选项|选项中有两项(?:为)?多余选项",
            "cloze": r"完形填空|完型填空|cloze",
            "grammar": r"语法填空|短文填空|填入适当的单词|括号内单词的正确形式",
            "practical_writing": r"应用文|书面表达|写一封|投稿|通知|邀请信|建议信",
            "continuation_writing": r"读后续写|续写|Paragraph 1|Paragraph 2",
        }
    )
    # Names a section is known by besides its own.
    aliases: dict[str, str] = field(
        default_factory=lambda: {
            "阅读A": "reading_a", "阅读A篇": "reading_a", "A": "reading_a", "阅读B": "reading_b", "阅读B篇": "reading_b", "B": "reading_b", "阅读C": "reading_c", "阅读C篇": "reading_c", "C": "reading_c", "阅读D": "reading_d", "阅读D篇": "reading_d", "D": "reading_d",
            "七选五": "gap_filling", "完形填空": "cloze", "完型填空": "cloze", "语法填空": "grammar", "应用文": "practical_writing", "读后续写": "continuation_writing", "作文续写": "continuation_writing",
        }
    )
    optional: tuple[str, ...] = ("gap_filling",)
    # Words that only answer keys and transcripts hold, that belong to the page, and that belong to model essays.
    leak_tokens: tuple[str, ...] = (
        "答案解析", "参考答案", "试题答案", "英语答案", "听力录音稿", "听力原文", "录音原文", "Text 1", "Text 2", "Text 3", "Text 4", "Text 5", "附：听力", "附听力", "第一节（共5小题）", "第二节（共15小题）",
    )
    layout_tokens: tuple[str, ...] = ("答题卡", "考号", "准考证号")
    essay_tokens: tuple[str, ...] = ("One possible version", "Possible version", "参考范文", "评分标准", "评分原则", "【导语】", "【详解】", "【点睛】")
    answer_words: str = "答案|参考答案|详解|解析|评分标准|评分细则"
    least_chars: int = 100
    most_chars: int = 12000

    def rank(self, section: str | None) -> int:
        """Place of a section; 99 for any other."""
        return self.order.index(section) if section in self.order else 99


DEFAULT = RulePack()
