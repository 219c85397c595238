"""An agreement corpus made of `documents`: numbered clauses chosen by doc_id, followed by the document's own text.

The same expression runs in Spark and, as SQL, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Heading and body of each clause; every category of the taxonomy is hit by at least one.
CLAUSES = [
    ("协议变更", "平台有权随时单方面修改本协议内容，您继续使用本服务即视为接受修改后的条款。"),
    ("争议解决", "因本协议产生的争议提交仲裁委员会仲裁解决，仲裁裁决为一裁终局。"),
    ("集体程序", "您同意放弃参加集体诉讼的权利。You waive the right to a class action."),
    ("信息共享", "我们可能收集您的位置、通讯录和设备信息，并向第三方合作伙伴共享以推送个性化广告。"),
    ("责任限制", "本服务按现状提供，对数据丢失平台不承担任何责任，赔偿总额不超过您已支付的费用。"),
    ("用户赔偿", "您同意赔偿平台因您的使用行为遭受的损失和律师费。"),
    ("费用与自动续费", "会员服务到期后将自动续费，如需取消请提前二十四小时操作；免费试用期结束后自动扣款。"),
    ("退款规则", "费用一经支付不予退还。All fees are non-refundable."),
    ("内容许可", "您授予我们全球范围内免费、永久、不可撤销的许可，并有权转授权给他人使用您上传的内容。"),
    ("权利归属", "您在服务中形成的作品，其知识产权归平台所有。"),
    ("意见反馈", "您提交的反馈可被我们免费使用。"),
    ("账号终止", "我们有权随时暂停或终止您的账号，账号内的余额概不退还。"),
    ("服务中止", "本公司有权随时中止全部服务。"),
    ("解释权", "本公司享有最终解释权。"),
    ("设备追踪", "我们使用Cookie识别并分析您的浏览行为，进行跨设备追踪。"),
    ("数据保留", "您注销账号后仍将保留必要信息，保留期限以法律要求为准。"),
    ("敏感信息", "为完成实名认证，我们会采集您的人脸和身份证信息。"),
    ("未成年人", "未满十八周岁的用户应当在监护人同意后使用本服务。"),
    ("内容责任", "您保证上传内容合法且不侵犯他人权利。You represent and warrant ownership."),
    ("通知送达", "公告一经发布即视为送达。"),
    ("协议转让", "本公司有权转让本协议权利义务，无需您同意。"),
    ("第三方服务", "第三方网站的内容我们不承担责任，不负责。"),
    ("法律适用", "本协议适用中华人民共和国法律，不可抗力造成的损失除外，并须遵守出口管制规定。"),
    ("可用性", "我们不保证服务不中断、无错误。"),
]
NUMBERS = "一二三四五六七八"


def agreements(spark: SparkSession, sf_dir: str, step: int = 5, own: bool = True) -> DataFrame:
    """doc_id, title, text: eight clauses per document and its own text behind them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    heads, bodies = F.array(*(F.lit(h) for h, _ in CLAUSES)), F.array(*(F.lit(b) for _, b in CLAUSES))

    def clause(j):
        k = (F.pmod(F.col("doc_id") * 7 + j * step, F.lit(len(CLAUSES))) + 1).cast("int")
        return F.concat(F.lit("第"), F.substring(F.lit(NUMBERS), j + 1, F.lit(1)), F.lit("条 "), F.element_at(heads, k), F.lit("\n"), F.element_at(bodies, k))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), clause), "\n\n")
    title = F.concat(F.lit("用户服务协议 "), F.col("doc_id").cast("string"))
    return docs.select("doc_id", title.alias("title"), F.concat(title if own else F.lit("用户服务协议"), F.lit("\n\n"), text, F.lit("\n\n第九条 附则\n"), F.col("own") if own else F.lit("完")).alias("text"))


def agreements_sql(step: int = 5, own: bool = True) -> str:
    """The same as a DuckDB query."""
    heads, bodies = (", ".join(f"'{x}'" for x in xs) for xs in zip(*CLAUSES, strict=True))
    return f"""SELECT doc_id, '用户服务协议 ' || doc_id AS title, '用户服务协议' || {"' ' || doc_id" if own else "''"} || chr(10) || chr(10) || array_to_string(list_transform(range(0, 8), lambda j:
      '第' || substr('{NUMBERS}', j + 1, 1) || '条 ' || (list_value({heads}))[(doc_id * 7 + j * {step}) % {len(CLAUSES)} + 1] || chr(10) || (list_value({bodies}))[(doc_id * 7 + j * {step}) % {len(CLAUSES)} + 1]), chr(10) || chr(10))
      || chr(10) || chr(10) || '第九条 附则' || chr(10) || {"coalesce(text, '')" if own else "'完'"} AS text FROM documents"""
