"""Risk taxonomy: what a clause can be flagged for, and the patterns that flag it."""

from __future__ import annotations

# Severities from worst to least, their labels and weights.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_LABELS = {"critical": "严重", "high": "高", "medium": "中", "low": "低", "info": "提示"}
SEVERITY_WEIGHTS = {"critical": 26, "high": 14, "medium": 7, "low": 3, "info": 1}

# Id, label, group, baseline severity, what it says, why it matters, and signals as (pattern, ignores case).
CATEGORIES = [
    (
        "unilateral_change",
        "单方变更权",
        "控制权不对等",
        "high",
        "平台可随时修改协议，且通常「继续使用即视为同意」，用户没有协商或拒绝的实际机会。",
        "你同意的其实是一份平台可以随时改写的合同，今天看到的条款不保证明天还有效。",
        [
            (r"(有权|可以|保留).{0,12}(随时|单方面|单方|不经通知|无需通知|不另行通知).{0,12}(修改|变更|更新|调整|修订)", False),
            (r"(修改|变更|更新).{0,10}(本协议|本条款|服务条款).{0,20}(无需|不需|不再|无须).{0,6}(另行)?通知", False),
            (r"继续使用.{0,16}(视为|即表示|即构成).{0,10}(接受|同意|认可).{0,10}(修改|变更|更新)?", False),
            (r"sole discretion to (modify|change|amend|update)", True),
            (r"(modify|amend|change|revise|update).{0,60}(terms|agreement|policy|conditions)", True),
            (r"(at any time|without notice|from time to time|sole discretion).{0,50}(modify|amend|change|revise|update)", True),
            (r"continued use.{0,40}(constitutes|means|shall constitute).{0,20}(accept|agree)", True),
        ],
    ),
    (
        "arbitration",
        "强制仲裁 / 管辖约定",
        "争议解决",
        "high",
        "约定争议通过特定仲裁机构解决，或约定由平台所在地法院管辖，通常排除用户所在地法院。",
        "维权成本被显著抬高：你需要去外地、按仲裁规则预缴费用，且仲裁一裁终局、基本无法上诉。",
        [
            (r"(仲裁委员会|仲裁机构).{0,20}(仲裁|解决)", False),
            (r"(排他性|专属).{0,6}管辖", False),
            (r"(由|提交).{0,16}(被告|原告)?(所在地|住所地)?(人民)?法院管辖", False),
            (r"(一裁终局|终局裁决)", False),
            (r"binding arbitration", True),
            (r"(exclusive|sole) jurisdiction", True),
            (r"waive.{0,20}(right to|jury trial)", True),
        ],
    ),
    (
        "class_action_waiver",
        "集体诉讼 / 集体维权放弃",
        "争议解决",
        "high",
        "要求用户放弃以集体诉讼、集团仲裁方式维权的权利，只能单独主张。",
        "小额损害本来靠集体诉讼才有维权可能，放弃后个体几乎不可能单独起诉。",
        [
            (r"集体诉讼", False),
            (r"团体诉讼", False),
            (r"class action", True),
            (r"(集团|集体).{0,6}仲裁", False),
            (r"class-wide", True),
        ],
    ),
    (
        "data_sharing",
        "数据收集与第三方共享",
        "隐私与数据",
        "high",
        "收集范围宽泛（如设备信息、位置、通讯录、使用行为），且可向「合作伙伴」「关联方」共享或出售。",
        "你的数据可能被用于精准营销、用户画像，甚至流转到你从未听说过的第三方。",
        [
            (r"(共享|提供|披露|转让|出售|交易).{0,16}(第三方|关联方|合作伙伴|合作方|广告主)", False),
            (r"(可能|将会|有权).{0,10}(收集|获取|采集).{0,20}(位置|通讯录|设备|行为|浏览|搜索|剪贴板)", False),
            (r"(个性化|精准).{0,6}(广告|推荐|营销)", False),
            (r"(share|sell|disclose|transfer|provide|disclose).{0,70}(third part|affiliat|partner|advertis|vendor|contractor|subsidiar)", True),
        ],
    ),
    (
        "liability_disclaimer",
        "免责条款 / 责任限制",
        "责任分配",
        "high",
        "平台对服务中断、数据丢失、内容错误等不承担责任，或将赔偿上限压到极低。",
        "服务出问题时你很难追责；「按现状提供」意味着风险基本由你承担。",
        [
            (r"(不承担|不负|免于|免除).{0,12}(任何|一切|全部)?(责任|赔偿责任)", False),
            (r"(按|以).{0,6}(现状|现有).{0,4}(提供|状态)", False),
            (r"(责任|赔偿).{0,8}(上限|限额|总额).{0,12}(不超过|以.{0,10}为限)", False),
            (r"(indemnif|hold harmless)", True),
            (r"(as is|as available).{0,20}(without warrant|no warrant)", True),
            (r"(shall not be liable|disclaim).{0,40}(liabilit|warrant)", True),
        ],
    ),
    (
        "indemnity",
        "用户赔偿义务",
        "责任分配",
        "medium",
        "要求用户因使用行为给平台造成的损失进行赔偿，包括第三方索赔与律师费。",
        "这是单向义务：你赔平台，平台未必赔你，且范围常常写得很宽。",
        [
            (r"您(同意|应当|须).{0,12}(赔偿|补偿).{0,16}(损失|费用|律师费)", False),
            (r"indemnify and hold harmless", True),
        ],
    ),
    (
        "auto_renewal",
        "自动续费 / 扣费",
        "费用与付费",
        "high",
        "订阅到期自动扣费续期，或免费试用结束后自动转为付费，取消入口往往不明显。",
        "容易在不知情的情况下被持续扣款，且取消流程可能被刻意设计得很麻烦。",
        [
            (r"自动(续费|续订|展期|延期)", False),
            (r"(到期|期满).{0,8}自动.{0,6}(续|扣|展期)", False),
            (r"(免费试用|试用期).{0,20}(结束|届满).{0,16}自动", False),
            (r"自动扣(款|费|划)", False),
            (r"(automatically renew|auto-renew)", True),
        ],
    ),
    (
        "refund",
        "退款与费用规则",
        "费用与付费",
        "medium",
        "费用一经支付不予退还，或退款条件苛刻、需扣除手续费。",
        "误购、服务不达预期时难以挽回损失。",
        [
            (r"(不(予|可|支持)|概不).{0,6}退(款|费|还)", False),
            (r"(费用|款项).{0,10}(一经|一旦).{0,6}(支付|缴纳).{0,10}(不退|不予退还)", False),
            (r"non-?refundable", True),
        ],
    ),
    (
        "content_license",
        "内容授权范围过宽",
        "知识产权",
        "high",
        "你发布的内容被授予「全球、永久、免费、可转授权、可商用」的许可。",
        "你创作的内容可能被平台无偿商用、改编甚至再授权给他人，且难以撤回。",
        [
            (r"(永久|无期限|不可撤销).{0,20}(许可|授权)", False),
            (r"(全球|全世界).{0,10}(范围)?(内)?(的)?(免费|无偿|非独占|排他)?(许可|授权)", False),
            (r"(可|有权).{0,8}(转授权|再许可|sublicense)", False),
            (r"(免费|无偿).{0,10}(使用|商业)?(使用)?(您|用户).{0,6}(上传|发布|提供).{0,6}(内容|作品|素材)", False),
            (r"perpetual,? irrevocable,? (worldwide|royalty-free)", True),
            (r"(sublicens|transferable).{0,20}licen[cs]e", True),
        ],
    ),
    (
        "ip_ownership",
        "知识产权归属",
        "知识产权",
        "medium",
        "约定用户创作内容的权利归属平台，或对平台标识、内容的使用施加限制。",
        "你的创作成果可能不再属于你。",
        [
            (r"(知识产权|著作权|所有权).{0,16}(归|属于).{0,10}(平台|本公司|我们|公司)", False),
            (r"work made for hire", True),
        ],
    ),
    (
        "feedback_license",
        "反馈/建议的无偿授权",
        "知识产权",
        "low",
        "你提交的建议、反馈可被平台自由使用且无需补偿。",
        "单独看影响有限，但常与内容授权条款叠加形成过度授权。",
        [
            (r"(反馈|建议|意见).{0,20}(免费|无偿|无需).{0,10}(使用|采纳|许可)", False),
            (r"feedback.{0,30}(without (obligation|compensation))", True),
        ],
    ),
    (
        "account_termination",
        "账号封禁与终止",
        "控制权不对等",
        "high",
        "平台可自行判断是否违规并单方封禁、删除账号及数据，无需事先通知或说明理由。",
        "账号内的内容、余额、虚拟财产可能一并消失，且申诉渠道有限。",
        [
            (r"(有权|可以).{0,12}(随时|立即|无需通知).{0,12}(暂停|终止|封禁|注销|删除).{0,10}(账号|账户|服务)", False),
            (r"(自行|单方|全权).{0,6}(判断|认定).{0,16}(违规|违约|不当)", False),
            (r"(不予|概不).{0,8}(退还|返还).{0,14}(余额|虚拟|费用|数据)", False),
            (r"(terminate|suspend).{0,20}(account|access).{0,20}(at any time|without notice|sole discretion)", True),
        ],
    ),
    (
        "service_change",
        "服务变更与中止",
        "控制权不对等",
        "medium",
        "服务可随时新增、修改、中止或下线，且不承担由此产生的损失。",
        "你依赖的服务可能消失，迁移成本由你承担。",
        [
            (r"(有权|可以).{0,10}(随时|自行).{0,10}(中止|终止|中断|下线|停止).{0,10}(服务|全部|部分)", False),
            (r"(discontinue|suspend).{0,20}service", True),
        ],
    ),
    (
        "unilateral_interpretation",
        "最终解释权 / 单方认定",
        "控制权不对等",
        "high",
        "约定协议的解释权归平台，或由平台单方认定用户是否违约。",
        "规则的解释者是对方，争议时你处于天然劣势。注：此类格式条款在国内消费者合同中常被认定无效。",
        [
            (r"(最终|唯一).{0,6}解释权", False),
            (r"本(协议|条款).{0,10}的解释权.{0,8}归", False),
            (r"final (interpretation|say)", True),
        ],
    ),
    (
        "privacy_tracking",
        "追踪与画像",
        "隐私与数据",
        "medium",
        "使用 Cookie、SDK、设备指纹等跨站追踪技术进行行为分析。",
        "你的浏览行为可能被长期记录并与第三方数据合并。",
        [
            (r"(Cookie|Cookies|SDK|设备标识|IMEI|OAID|IDFA).{0,24}(追踪|跟踪|识别|分析)", False),
            (r"(跨(站|设备)|行为).{0,8}(追踪|跟踪)", False),
            (r"(track|fingerprint).{0,20}(across|behaviou?r)", True),
        ],
    ),
    (
        "data_retention",
        "数据保留与删除",
        "隐私与数据",
        "medium",
        "数据保留期限模糊，或注销后仍保留、无法彻底删除。",
        "你行使「删除权」时可能被以「法律法规要求」为由长期保留。",
        [
            (r"(保留|存储).{0,16}(期限|期间).{0,10}(不明确|必要|法律)", False),
            (r"(注销|删除).{0,20}(仍|继续).{0,10}(保留|保存)", False),
            (r"(retain|retention).{0,20}(as required|necessary)", True),
        ],
    ),
    (
        "sensitive_data",
        "敏感个人信息",
        "隐私与数据",
        "high",
        "涉及生物识别、医疗健康、金融账户、行踪轨迹、未成年人信息等敏感个人信息处理。",
        "敏感信息一旦泄露后果严重，且处理需单独同意。",
        [
            (r"(人脸|面部识别|指纹|声纹|虹膜|生物识别)", False),
            (r"(健康|医疗|病历)", False),
            (r"(身份证|银行卡|金融账户|征信)", False),
            (r"(行踪轨迹|精确定位)", False),
            (r"biometric|health data", True),
        ],
    ),
    (
        "minor_consent",
        "未成年人保护",
        "特殊主体",
        "medium",
        "对未成年人使用的年龄门槛与监护人同意的处理方式。",
        "若产品面向未成年人却未设置有效同意机制，家长权利与孩子信息都存在风险。",
        [
            (r"(未满|不满).{0,4}(14|18|十六|十八).{0,4}(周岁|岁)", False),
            (r"(监护人|法定代理人).{0,8}(同意|陪同)", False),
            (r"(children|minor).{0,20}(under|consent)", True),
        ],
    ),
    (
        "user_content_responsibility",
        "用户内容担保责任",
        "责任分配",
        "medium",
        "用户需保证上传内容合法且不侵权，并独自承担由此产生的全部责任。",
        "平台把内容合规风险全部转移给你。",
        [
            (r"(保证|承诺).{0,16}(不(会)?(侵犯|违反)|合法).{0,16}(权利|法律)", False),
            (r"(因此|由此).{0,10}产生.{0,10}(全部|一切).{0,6}责任.{0,6}(由您|由用户)", False),
            (r"represent and warrant", True),
        ],
    ),
    (
        "notice_method",
        "通知方式与送达",
        "程序性条款",
        "low",
        "平台通过站内信、注册邮箱或公告即可视为有效送达，用户有义务自行关注。",
        "你可能因未看到通知而被认定「已知悉」，从而丧失抗辩空间。",
        [
            (r"(视为|即视为).{0,10}(送达|收到|知悉)", False),
            (r"(站内信|站内通知|公告|注册邮箱).{0,16}(视为|即).{0,8}(通知|送达)", False),
            (r"(deemed|constitute).{0,16}(notice|received)", True),
        ],
    ),
    (
        "assignment",
        "协议转让",
        "程序性条款",
        "low",
        "平台可将协议权利义务转让给第三方（如被收购时），用户无权反对。",
        "你签的合同可能在没有你同意的情况下换了相对方。",
        [
            (r"(有权|可以).{0,10}(转让|转移).{0,12}(本协议|权利义务).{0,12}(无需|不需|不必).{0,8}(同意|通知)", False),
            (r"assign.{0,20}(without|at its).{0,20}(consent|discretion)", True),
        ],
    ),
    (
        "third_party_service",
        "第三方服务与链接",
        "外部依赖",
        "low",
        "服务包含第三方内容或链接，平台不对第三方行为负责。",
        "风险被转嫁给用户自行判断。",
        [
            (r"(第三方|外部)(网站|链接|服务|内容).{0,20}(不(承担|负责)|免责)", False),
            (r"not responsible for.{0,20}third.?part", True),
        ],
    ),
    (
        "governing_law",
        "法律适用",
        "争议解决",
        "low",
        "约定适用特定国家/地区的法律。",
        "与管辖条款叠加时，可能使你适用完全陌生的法律体系。",
        [
            (r"(适用|依据).{0,8}(中华人民共和国|中国|香港|新加坡|美国|加州).{0,6}法律", False),
            (r"governed by the laws of", True),
        ],
    ),
    (
        "service_availability",
        "服务可用性承诺缺失",
        "责任分配",
        "medium",
        "未承诺可用性指标（SLA），或明确不保证服务不中断、无错误。",
        "付费服务若频繁故障，你缺少合同依据主张补偿。",
        [
            (r"(不保证|无法保证).{0,16}(不中断|无错误|及时|安全|可靠)", False),
            (r"(no warrant|does not warrant).{0,30}(uninterrupted|error-free)", True),
        ],
    ),
    (
        "export_control",
        "出口管制与合规",
        "合规义务",
        "info",
        "用户需自行遵守出口管制、制裁等合规要求。",
        "常规条款，但跨国使用时值得留意。",
        [
            (r"(出口管制|制裁|禁运)", False),
            (r"export control|sanction", True),
        ],
    ),
    (
        "force_majeure",
        "不可抗力免责",
        "责任分配",
        "info",
        "因不可抗力导致的服务中断不承担责任，但范围可能被写得过宽。",
        "常规条款；若把「第三方原因」「设备故障」也算作不可抗力则偏宽。",
        [
            (r"(不可抗力|情势变更)", False),
            (r"force majeure", True),
        ],
    ),
    (
        "other",
        "其他值得注意",
        "其他",
        "low",
        "不属于上述类别、但依然可能对用户不利的条款。",
        "分类兜底项。",
        [
        ],
    ),
]

# What to do about each category.
ADVICE = {
    "unilateral_change": "定期回看协议更新记录，重大变更前留存旧版本。",
    "arbitration": "评估维权成本；如有异议可在签约前提出。",
    "class_action_waiver": "注意你只能单独主张权利，小额损失实际难以追偿。",
    "data_sharing": "在隐私设置中关闭个性化推荐与第三方共享。",
    "liability_disclaimer": "重要数据自行备份，不要依赖平台的可用性承诺。",
    "indemnity": "避免上传可能侵权的第三方内容。",
    "auto_renewal": "开通后立刻在支付渠道或账号设置中关闭自动续费。",
    "refund": "付费前确认退款规则，优先选择可按月付费。",
    "content_license": "谨慎上传原创作品；必要时先在其他平台留证。",
    "ip_ownership": "确认你的创作成果归属，必要时另行书面约定。",
    "feedback_license": "无需特别处理，了解即可。",
    "account_termination": "定期导出自己的数据与内容，不要只存在云端。",
    "service_change": "不要把该服务作为唯一依赖，准备替代方案。",
    "unilateral_interpretation": "此类条款在国内消费者合同中常被认定无效，可主张权利。",
    "privacy_tracking": "使用浏览器隐私模式、清理 Cookie 或限制广告追踪。",
    "data_retention": "注销账号前先导出数据，并书面要求删除。",
    "sensitive_data": "谨慎提供生物识别、金融账户等敏感信息。",
    "minor_consent": "如为未成年人使用，请监护人确认并开启青少年模式。",
    "user_content_responsibility": "确保上传内容拥有合法授权。",
    "notice_method": "定期查收注册邮箱与站内通知，避免错过变更。",
    "assignment": "了解你的合同相对方可能变更。",
    "third_party_service": "点击第三方链接前确认其隐私政策。",
    "governing_law": "了解适用法律与你的所在地是否一致。",
    "service_availability": "付费前确认是否有服务可用性承诺。",
    "export_control": "常规合规条款，了解即可。",
    "force_majeure": "常规条款，了解即可。",
    "other": "建议仔细阅读该条款原文。",
}

# Categories that matter together: both ids, severity, title, explanation, scenario.
INTERACTIONS = [
    (
        ("content_license", "account_termination"),
        "high",
        "内容授权 + 账号终止",
        "内容授权条款通常约定「永久、不可撤销」，而账号终止条款允许平台随时封禁账号。两者合起来意味着：即使你被踢出平台，你发布的内容依然被对方永久授权使用。",
        "被误封账号后想撤回内容，但授权是不可撤销的，无从主张。",
    ),
    (
        ("unilateral_change", "liability_disclaimer"),
        "high",
        "单方变更 + 免责",
        "平台可以随时改协议，同时又对服务中断、数据丢失免责。两条叠加意味着规则随时可变，而改变带来的后果由你承担。",
        "平台改版导致你的数据丢失，但免责条款挡住了追责。",
    ),
    (
        ("data_sharing", "privacy_tracking"),
        "high",
        "数据共享 + 跨设备追踪",
        "既能跨设备追踪你的行为，又能把这些信息共享给关联方和合作伙伴。合起来就是一套完整的用户画像与商业化链条。",
        "你在 A 设备的搜索行为，最终变成了另一家公司投放给你的广告。",
    ),
    (
        ("data_retention", "account_termination"),
        "medium",
        "数据保留 + 账号终止",
        "一边给了你注销账号的权利，另一边又规定注销后仍会被保留必要信息。这实际上架空了删除权。",
        "注销账号后，你的数据仍在对方服务器上。",
    ),
    (
        ("arbitration", "liability_disclaimer"),
        "high",
        "强制仲裁 + 免责",
        "争议必须去指定的仲裁机构，且对方已广泛免责。这意味着维权成本高、可主张的空间又小，实际上很难获得救济。",
        "服务出问题造成损失，但你既难以起诉，对方又基本免责。",
    ),
    (
        ("auto_renewal", "refund"),
        "medium",
        "自动续费 + 不予退款",
        "到期自动扣费，且费用一经支付不予退还。忘记取消就会持续失血，且无法追回。",
        "忘记取消订阅，连续被扣了几个月才发现。",
    ),
    (
        ("content_license", "ip_ownership"),
        "medium",
        "内容授权 + 知识产权归属",
        "一边约定你的内容权利归平台，一边又要求你授予永久免费许可。两条合起来，你的创作基本不再属于你。",
        "你上传的原创作品被平台商用，且无法要求分成或下架。",
    ),
]

# What a question says, and the contract terms it then also looks for.
SYNONYMS = [
    (r"退(钱|费|款)|能退|想退|可以退|退款", ["退款", "退还", "不予退还", "费用", "支付"]),
    (r"封号|被封|账号.{0,4}(停|禁|没|注销)|注销", ["暂停", "终止", "封禁", "注销", "账号"]),
    (r"(数据|信息|资料|隐私).{0,8}(共享|提供|披露|出售|卖出|卖给|泄露|给谁)|(共享|提供|披露|出售|卖出|卖给|泄露).{0,8}(数据|信息|资料)|第三方|关联方|隐私", ["共享", "提供", "披露", "第三方", "关联方", "合作伙伴", "个人信息"]),
    (r"自动|续费|扣费|扣款|订阅", ["自动续费", "扣款", "订阅", "期满", "到期"]),
    (r"我.{0,4}(内容|作品|文章|发的|上传)|原创|版权|著作权", ["内容", "上传", "发布", "许可", "授权", "知识产权"]),
    (r"追踪|跟踪|监控|定位|行踪|行为", ["收集", "追踪", "位置", "设备", "浏览"]),
    (r"删(除|掉)|注销后|保留多久|保存多久", ["删除", "保留", "存储", "期限", "注销"]),
    (r"赔|责任|损失|出事|坏了", ["责任", "赔偿", "免责", "损失", "不承担"]),
    (r"争议|起诉|打官司|仲裁|法院|维权", ["仲裁", "管辖", "争议", "诉讼", "法院"]),
    (r"改.{0,4}(协议|条款|规则)|变更|修改|更新", ["修改", "变更", "通知", "更新", "调整"]),
    (r"未成年|小孩|儿童|孩子", ["未成年", "监护人", "法定代理人", "儿童"]),
    (r"收费|多少钱|价格|付费|会员", ["费用", "价格", "付费", "会员", "服务费"]),
]
