"""Chinese result tables: values by literal maps, headers by renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the Chinese tables.
GROUP_TYPES = {"single": "单药", "combination": "联合用药"}
SOURCE_TYPES = {"post": "主帖", "comment": "评论"}
OUTCOMES = {"resolved": "已缓解", "improving": "正在改善", "ongoing": "持续中", "worsening": "正在恶化", "unknown": "未知"}
VALIDATION = {"exact": "精确匹配", "unmatched": "未匹配", "not_checked": "未校验"}
HEADERS = {
    "record_id": "记录ID", "user_id": "用户伪名ID", "source_type": "来源类型", "thread_id": "讨论串ID", "parent_id": "父级ID", "subreddit": "Reddit社区", "date": "日期",
    "has_target_exposure": "是否识别到目标药物暴露", "n_regimens": "用药阶段数", "exposure_groups": "暴露组", "exposure_group": "暴露组", "group_type": "暴露类型", "n_target_drugs": "目标药物数",
    "has_adverse_events": "是否有不良反应", "original_expression": "用户原始症状表述", "proposed_meddra_pt": "MedDRA PT候选（英文）", "meddra_pt": "MedDRA PT（英文）", "meddra_pt_zh": "医学术语中文辅助释义",
    "meddra_pt_code": "MedDRA PT代码", "validated_meddra_pt": "已校验MedDRA PT（英文）", "meddra_validation": "MedDRA校验状态", "onset": "发生时间", "severity": "严重程度", "outcome": "转归", "confidence": "模型置信度",
    "n_records": "记录数", "n_exposed_users": "暴露用户数", "n_event_users": "不良反应报告用户数", "n_users": "报告该症状的用户数", "percent_of_exposed_users": "占暴露用户比例（%）", "percent_of_event_reporters": "占不良反应报告者比例（%）",
}


def mapped(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    if not labels:
        return c
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def exposure_group(c: Column, drugs: dict[str, str]) -> Column:
    """Each drug of ``a + b`` by its label."""
    parts = F.transform(F.split(c, r"\+"), lambda x: mapped(F.lower(F.trim(x)), drugs))
    return F.array_join(F.filter(parts, lambda x: x != ""), " + ")


def chinese(df: DataFrame, drugs: dict[str, str], rename: bool = True) -> DataFrame:
    """``df`` with translated values, and headers too unless ``rename`` is off."""
    out = df
    if "exposure_group" in df.columns:
        out = out.withColumn("exposure_group", exposure_group(F.col("exposure_group"), drugs))
    if "exposure_groups" in df.columns:
        groups = F.filter(F.split("exposure_groups", r" \| "), lambda x: x != "")
        out = out.withColumn("exposure_groups", F.array_join(F.transform(groups, lambda g: exposure_group(g, drugs)), " | "))
    for c, labels in (("group_type", GROUP_TYPES), ("source_type", SOURCE_TYPES), ("outcome", OUTCOMES), ("meddra_validation", VALIDATION)):
        if c in df.columns:
            out = out.withColumn(c, mapped(F.col(c), labels))
    return out.withColumnsRenamed({k: v for k, v in HEADERS.items() if k in df.columns}) if rename else out
