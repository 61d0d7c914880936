"""Default parameters: dictionaries, patterns, thresholds and wording.

Everything here is data.  Each operator takes its dictionary as an argument and
uses the table below as the default, so a corpus with another vocabulary only
needs other tables.
"""

# ---------------------------------------------------------------------------
# Fixed values (interoperability): labels, keyword lists, patterns, thresholds
# and result wording must equal the ones existing data was produced with.
# ---------------------------------------------------------------------------

CLAUSE_LABELS = [
    "合同基本信息", "甲乙方信息", "合同金额", "付款条件", "履约期限", "服务/采购/工程内容", "验收标准",
    "违约责任", "权利义务", "保密条款", "争议解决", "账户信息", "附件条款", "其他重要条款",
]
DEFAULT_LABEL = "其他重要条款"

OVERVIEW_DEFAULTS = [("合同编号", "未提取"), ("主体摘要", "待补充"), ("甲乙方信息", "待补充"), ("服务内容", "待补充")]

NUMERAL = "一二三四五六七八九十百零"
HEADING_RULES = [  # (pattern over blank-free text, level)
    (r"^第[一二三四五六七八九十百零\d]+[章节条款部分]", 1),
    (r"^[一二三四五六七八九十]+、", 1),
    (r"^\d+[.、]", 2),
    (r"^[（(][一二三四五六七八九十\d]+[)）]", 3),
]
SECTION_TITLE_BLOCKLIST = [
    "合同编号", "填写说明", "技术服务合同", "合同类别", "合同交易额", "技术交易额", "申请登记人", "登记法人",
    "登记材料", "法定代表人", "项目联系人", "通讯地址", "开户银行", "户名", "帐号",
]
LAYOUT_HEADING_TOKENS = ["合同", "条款", "标准", "金额", "付款"]

ANCHOR_KEYWORDS = {
    "甲乙方信息": ["甲方", "乙方", "委托方", "受托方"],
    "合同金额": ["合同金额", "总额", "人民币", "金额"],
    "付款条件": ["付款", "支付", "比例", "节点"],
    "履约期限": ["期限", "工期", "完成时间", "服务期"],
    "服务/采购/工程内容": ["服务内容", "工作内容", "技术服务", "采购内容", "工程内容"],
    "验收标准": ["验收", "交付", "成果", "标准"],
    "违约责任": ["违约", "赔偿", "责任", "逾期"],
    "争议解决": ["争议", "仲裁", "法院", "协商"],
    "账户信息": ["账户", "账号", "开户行", "银行"],
    "附件条款": ["附件", "附表", "补充协议"],
}
CORE_LABEL_ALIASES = {
    "合同主体信息": "甲乙方信息", "主体信息": "甲乙方信息", "主体条款": "甲乙方信息",
    "付款方式": "付款条件", "支付条件": "付款条件",
    "合同价款": "合同金额", "合同总金额": "合同金额",
    "服务内容": "服务/采购/工程内容", "采购内容": "服务/采购/工程内容", "工程内容": "服务/采购/工程内容",
    "履行期限": "履约期限", "验收要求": "验收标准", "验收条件": "验收标准", "银行账户信息": "账户信息",
}
OVERVIEW_ALIASES = {
    "合同编号": "合同编号", "协议编号": "合同编号", "编号": "合同编号",
    "主体摘要": "主体摘要", "合同摘要": "主体摘要", "主体信息摘要": "主体摘要",
    "甲乙方信息": "甲乙方信息", "合同主体信息": "甲乙方信息", "主体信息": "甲乙方信息",
    "服务内容": "服务内容", "项目内容": "服务内容", "合同服务内容": "服务内容", "服务/采购/工程内容": "服务内容",
}
CONTRACT_NUMBER_PATTERNS = [
    r"(?:合同|协议|项目)?(?:编号|备案号|合同编号|协议编号)\s*[:：]?\s*([A-Za-z0-9一-龥\-_/().（）]{4,80})",
    r"\b([A-Z]{1,8}-\d{4,}[-A-Z0-9/]*)\b",
    r"\b(\d{2,}-\d{4,}[A-Za-z0-9-]*)\b",
]
#: Every hit of a pattern holds one of these words and, if there is one, a match of the sign, which is cheaper to look for.
CONTRACT_NUMBER_NEEDS = [(["编号", "备案号"], ""), (["-"], r"-\d{4}"), (["-"], r"-\d{4}")]
PARTY_PATTERN = r"(甲方|乙方|委托方|受托方)\s*[（(]?[)：)]?\s*[:：]?\s*([^\n（()）]{2,80})"
AMOUNT_PATTERN = r"(?:人民币|合同总额|总金额|金额)[^0-9]{0,8}([0-9][0-9,，.]*\s*(?:元|万元)?)"
CROSS_REF_PATTERN = r"(第[一二三四五六七八九十百零\d]+条|附件[一二三四五六七八九十\d]+)"
SECTION_MARK_PATTERN = r"(第[一二三四五六七八九十百零〇\d]+条)[：:、]?"
CITATION_MARKERS = ["本合同", "违反", "按照", "依照", "依据"]

CATEGORY_KEYWORDS = {
    "建设工程类": ["工程", "施工", "监理", "勘察", "设计", "总承包", "分包", "造价", "项目管理", "建设项目"],
    "买卖合同类": ["采购", "销售", "买卖", "货物", "物资", "设备供货", "材料供应"],
    "租赁合同类": ["租赁", "房屋租赁", "设备租赁", "车辆租赁", "场地租赁"],
    "运输合同类": ["运输", "货运", "物流", "承运", "配送"],
    "服务合同类": ["服务", "技术服务", "咨询", "检测", "评估", "法律服务", "代理", "维护", "运维"],
}
DEFAULT_CATEGORY = "通用合同类"

SCHEMA_ALIASES = {
    "contract_number": ["合同编号", "协议编号"],
    "contract_parties": ["甲方", "乙方", "合同主体", "主体"],
    "unified_social_credit_code": ["统一社会信用代码", "纳税人识别号"],
    "legal_representative": ["法定代表人", "授权代表", "签章"],
    "contract_subject": ["合同标的", "标的", "服务内容", "采购内容"],
    "quantity": ["数量"],
    "quality": ["质量", "规格"],
    "price": ["价款", "合同金额", "总价", "计价方式"],
    "tax_rate": ["税率", "含税", "不含税"],
    "invoice": ["发票"],
    "payment_terms": ["付款", "支付"],
    "delivery_term": ["交付期限", "履行期限", "服务期限", "工期"],
    "acceptance_standard": ["验收", "检验标准", "质量标准"],
    "breach_liability": ["违约责任", "违约"],
    "termination": ["解除", "终止"],
    "confidentiality": ["保密"],
    "intellectual_property": ["知识产权"],
    "dispute_resolution": ["争议解决", "仲裁", "诉讼"],
    "signing_place": ["签署地", "签订地点"],
    "effectiveness_condition": ["生效条件", "生效"],
    "attachments": ["附件", "清单"],
}

CLAUSE_TYPE_KEYWORDS = {
    "payment": ["付款", "支付", "价款"],
    "invoice": ["发票", "税率", "含税"],
    "acceptance": ["验收", "检验", "质量标准"],
    "breach": ["违约责任", "违约"],
    "dispute": ["争议解决", "仲裁", "诉讼"],
    "confidentiality": ["保密"],
    "termination": ["解除", "终止"],
}
RISK_TAG_KEYWORDS = {
    "payment": ["付款", "预付款", "支付"],
    "invoice": ["发票", "税率", "含税", "不含税"],
    "dispute": ["争议解决", "仲裁", "诉讼"],
    "breach": ["违约"],
}
CHAPTER_PATTERN = r"第[一二三四五六七八九十百千]+章[^\n]*"
ARTICLE_PATTERN = r"第[一二三四五六七八九十百千]+条[^\n]*"
DEFAULT_CHAPTER = "总则"
TEMPLATE_HEADINGS = [r"第[一二三四五六七八九十百千]+条", r"\n[一二三四五六七八九十]+、", r"\n\d+\.\d+(?:\.\d+)?[^\d]"]
CATALOG_LV1 = r"^[一二三四五六七八九十]+、\s*(.+类)$"
CATALOG_LV2 = r"^(\d+\.\d+)\s*(.+)$"
CATALOG_LINE = r"^(\d+\.\d+\.\d+)\s*(.+?)\.{2,}\s*(\d+)$"
CONTENTS_PAGES = 8

# (id, name, severity, department, keywords, logic type, fields, min length, suggestion)
RULES = [
    ("RULE_001", "未匹配到有效标准范本", "must_modify", "business", ["合同范本", "标准模板", "审核"], "template_required", [], 0, "请为当前合同选择并套用有效标准范本。"),
    ("RULE_002", "待审合同类型与所选范本类型不一致", "must_modify", "business", ["适用范围", "合同类型"], "template_category_match", [], 0, "请改用与合同类型一致的标准范本。"),
    ("RULE_003", "缺少合同主体信息", "must_modify", "legal", ["主体", "资格"], "schema_required", ["contract_parties"], 0, "请补充甲乙双方主体信息。"),
    ("RULE_004", "缺少统一社会信用代码", "suggest_modify", "legal", ["统一社会信用代码", "纳税人识别号"], "schema_required", ["unified_social_credit_code"], 0, "建议补充统一社会信用代码或纳税人识别号。"),
    ("RULE_005", "缺少授权代表或签章信息", "must_modify", "legal", ["授权代表", "签章"], "schema_required", ["legal_representative"], 0, "请补充法定代表人、授权代表或签章信息。"),
    ("RULE_006", "缺少合同标的", "must_modify", "business", ["标的", "内容"], "schema_required", ["contract_subject"], 0, "请补充明确的合同标的或服务 / 采购内容。"),
    ("RULE_007", "合同标的不清晰", "suggest_modify", "business", ["明确", "内容"], "field_length_min", ["contract_subject"], 12, "请细化合同标的的内容、范围和交付对象。"),
    ("RULE_008", "缺少数量 / 质量 / 规格", "suggest_modify", "business", ["数量", "质量", "规格"], "required_any", ["quantity", "quality"], 0, "请补充数量、质量或规格标准。"),
    ("RULE_009", "缺少履行期限", "must_modify", "business", ["期限", "工期"], "schema_required", ["delivery_term"], 0, "请补充明确的履行或交付期限。"),
    ("RULE_010", "缺少验收标准", "must_modify", "business", ["验收", "质量标准"], "schema_required", ["acceptance_standard"], 0, "请补充验收标准、流程及验收依据。"),
    ("RULE_011", "缺少价款或计价方式", "must_modify", "finance", ["价款", "计价"], "schema_required", ["price"], 0, "请补充价款金额或计价方式。"),
    ("RULE_012", "缺少含税/不含税/税率约定", "suggest_modify", "finance", ["税率", "含税", "不含税"], "schema_required", ["tax_rate"], 0, "建议明确含税/不含税口径和适用税率。"),
    ("RULE_013", "缺少发票要求", "suggest_modify", "finance", ["发票"], "schema_required", ["invoice"], 0, "建议补充发票类型、税率和开票要求。"),
    ("RULE_014", "付款条件未绑定验收和发票", "must_modify", "finance", ["付款", "验收", "发票"], "payment_acceptance_invoice", [], 0, "请将付款条件与验收完成、发票开具等前提绑定。"),
    ("RULE_015", "存在无条件全额预付款", "must_modify", "finance", ["预付款", "支付"], "prepayment", [], 0, "请取消或限制无条件全额预付款安排。"),
    ("RULE_016", "缺少违约责任", "must_modify", "legal", ["违约责任", "违约"], "schema_required", ["breach_liability"], 0, "请补充违约责任条款。"),
    ("RULE_017", "违约责任明显不对等", "suggest_modify", "legal", ["违约责任", "责任明确"], "breach_equity", [], 0, "建议校核双方违约责任是否明显失衡。"),
    ("RULE_018", "缺少争议解决条款", "must_modify", "legal", ["争议解决"], "schema_required", ["dispute_resolution"], 0, "请补充争议解决条款。"),
    ("RULE_019", "争议解决地偏向乙方", "suggest_modify", "legal", ["争议解决", "诉讼", "仲裁"], "dispute_bias", [], 0, "建议调整争议解决地或管辖约定，避免明显偏向对方。"),
    ("RULE_020", "引用废止制度/旧范本", "must_modify", "legal", ["修订", "废止", "替代"], "reference_outdated", [], 0, "请核对并替换为当前有效制度或范本引用。"),
]
OUTDATED_TYPES = ["payment", "dispute", "breach"]
VENUE_WORDS = ["乙方所在地", "乙方住所地", "对方所在地"]

# (rule key, condition, config id, rule id, name, severity, reason, depends on)
DECISION_RULES = [
    ("rule_missing_contract_number", "contract.contractNumber == null or contract.contractNumber == ''", "config_rule_missing_contract_number", "missing_contract_number", "合同编号缺失", "medium", "未成功提取合同编号，建议回看首页、签署页或页眉页脚并人工复核。", ["合同编号"]),
    ("rule_payment_without_acceptance_gate", "derived.hasPaymentClause == true and derived.hasAcceptanceClause == false", "config_rule_payment_without_acceptance_gate", "payment_without_acceptance_gate", "付款条款缺少验收约束", "high", "识别到付款条款，但未识别到明确验收标准，存在先付款后验收风险。", ["付款条件", "验收标准"]),
    ("rule_missing_breach_clause", "derived.hasBreachClause == false", "config_rule_missing_breach_clause", "missing_breach_clause", "违约责任条款缺失", "medium", "未识别到违约责任条款，建议核查合同责任约束是否完整。", ["违约责任"]),
    ("rule_missing_account_info", "entities.accountInfo == null or entities.accountInfo == ''", "config_rule_missing_account_info", "missing_account_info", "账户信息缺失", "medium", "未抽取到账户信息。若合同涉及付款执行，建议补充收款账户核验。", ["账户信息"]),
    ("rule_amount_present_but_payment_missing", "entities.contractAmount != null and entities.contractAmount != '' and derived.hasPaymentClause == false", "config_rule_amount_present_but_payment_missing", "amount_present_but_payment_missing", "有金额但缺少付款安排", "high", "已识别合同金额，但未识别到付款条款，建议核查付款安排是否缺失。", ["合同金额", "付款条件"]),
]

# (position, id, name, description, risk prompt, tools, priority, config type, rule id, severity, expected clauses, expected facts, extract fields)
AUDIT_CONFIGS = [
    (1, "relation_001", "疑似内部关联交易核验", "识别甲乙方、供应商、项目与账户信息中可能存在的关联交易线索。", "请基于合同主体、项目和账户线索判断是否存在疑似内部关联交易方向，仅输出待核验事项。", ["model_inference", "knowledge_graph_future", "enterprise_relation_future"], "high", "relation_focus", None, None, [], [], []),
    (2, "relation_002", "合同-付款节点关系", "分析合同金额、付款比例与验收节点是否匹配。", "关注付款比例、付款触发条件与验收条款之间是否存在前置付款风险。", ["model_inference", "rule_engine_future", "rpa_api_future"], "high", "relation_focus", None, None, [], [], []),
    (3, "relation_003", "供应商关系待核验", "检查供应商名称、股东、法人和账户信息是否需要外部关系库核验。", "如合同文本出现集团内部名称相似性或账户异常，请提示需要接入主数据与企业关系库。", ["model_inference", "enterprise_relation_future", "internal_master_data_future"], "medium", "external_check", None, None, [], [], []),
    (4, "rule_001", "付款条款缺少验收约束", "当存在付款条款但未看到明确验收后付款约束时触发。", "识别付款是否与验收闭环脱节，提示先付款后验收风险。", ["rule_engine_future", "model_inference"], "high", "rule_check", "payment_without_acceptance_gate", "high", ["付款条件", "验收标准"], [], [("付款条件", "提取付款触发条件、比例和节点"), ("验收标准", "提取验收是否作为付款前置条件")]),
    (5, "rule_002", "合同编号缺失", "当合同编号未成功抽取时触发。", "检查合同首页是否存在合同编号或协议编号，缺失时提示人工复核。", ["rule_engine_future", "model_inference"], "medium", "rule_check", "missing_contract_number", "medium", [], ["合同编号"], [("合同编号", "仅提取合同编号本身，不要返回合同名称")]),
    (6, "rule_003", "违约责任条款缺失", "当合同中未识别到违约责任条款时触发。", "检查合同是否设置了违约责任和赔偿约束，缺失时给出提示。", ["rule_engine_future", "model_inference"], "medium", "rule_check", "missing_breach_clause", "medium", ["违约责任"], [], [("违约责任", "提取违约责任、赔偿约束和逾期责任")]),
    (7, "rule_004", "账户信息缺失", "当合同中未识别到账户信息时触发。", "检查合同是否提供了收款账户信息，缺失时提示付款执行风险。", ["rule_engine_future", "model_inference"], "medium", "rule_check", "missing_account_info", "medium", [], ["账户信息"], [("账户信息", "提取开户名、开户行、账号等账户字段")]),
    (8, "rule_005", "有金额但缺少付款安排", "当已识别合同金额但未识别付款条款时触发。", "检查合同是否存在金额约定但未写明付款安排，提示履约结算风险。", ["rule_engine_future", "model_inference"], "high", "rule_check", "amount_present_but_payment_missing", "high", [], ["合同金额", "付款条件"], [("合同金额", "提取合同总金额、含税金额或价税合计"), ("付款条件", "提取付款节点、付款比例和支付方式")]),
]

# template re-scoring: profile words -> (name / category word, points, reason)
PROFILE_WORDS = {
    "technical": ["技术服务合同", "专项技术服务", "服务内容", "成果交付", "数据采集服务"],
    "survey": ["测量", "测绘", "勘察测量", "控制测量", "纵横断面", "点云", "激光雷达", "数据采集", "勘测"],
    "audit": ["审计", "审计报告", "注册会计师", "被审计单位", "审计准则", "审计成果"],
    "detection": ["检测", "检验", "试验"],
    "legal": ["法律服务", "律师", "法律意见"],
    "appraisal": ["评估", "资产评估"],
    "engineering": ["工程勘察", "工程设计", "勘察设计", "设计服务"],
}
# (order, profile, profile must be present, template column, word, exact match, points, reason)
TEMPLATE_ADJUSTMENTS = [
    (1, "technical", True, "template_name", "技术服务合同", False, 12.0, "合同标题与技术服务模板直接对应"),
    (2, "technical", True, "template_name", "第三方审计合同", False, -10.0, "合同标题明确为技术服务，不应优先匹配审计模板"),
    (3, "survey", True, "template_name", "技术服务合同", False, 10.0, "合同内容包含测量/点云/数据采集等技术服务特征"),
    (4, "survey", True, "template_name", "工程勘察合同", False, 6.0, "合同内容包含勘察测量特征"),
    (5, "survey", True, "template_name", "第三方审计合同", False, -12.0, "合同内容与审计业务特征明显不符"),
    (6, "audit", True, "template_name", "第三方审计合同", False, 14.0, "合同内容出现审计业务特征"),
    (7, "audit", False, "template_name", "第三方审计合同", False, -5.0, "未出现审计业务关键词"),
    (8, "detection", True, "template_name", "检测委托合同", False, 8.0, "合同内容出现检测类特征"),
    (9, "legal", True, "template_name", "法律服务合同", False, 10.0, "合同内容出现法律服务特征"),
    (10, "appraisal", True, "template_name", "资产评估服务合同", False, 10.0, "合同内容出现评估类特征"),
    (11, "engineering", True, "category_lv2", "工程勘察设计合同", True, 4.0, "合同内容与工程勘察设计存在关联"),
]

VERIFY_REQUIRED = ["付款条件", "验收标准", "违约责任", "争议解决"]
VERIFY_KEYWORDS = {
    "付款条件": ["付款", "支付", "金额", "比例", "节点"],
    "验收标准": ["验收", "交付", "确认", "标准"],
    "违约责任": ["违约", "赔偿", "逾期", "责任"],
    "争议解决": ["争议", "仲裁", "法院", "协商"],
}
FOCUS_LABELS = {
    "performance": ["付款条件", "验收标准", "违约责任", "权利义务", "履约期限", "附件条款"],
    "relation": ["甲乙方信息", "账户信息", "合同金额", "付款条件", "其他重要条款"],
}
RELATION_WORDS = [("账户", "账户信息"), ("供应商", "甲乙方信息"), ("付款", "付款条件"), ("项目", "服务/采购/工程内容")]
FIELD_TITLES = [
    ("合同编号", "contract_number"), ("协议编号", "contract_number"), ("合同主体", "contract_parties"),
    ("统一社会信用代码", "unified_social_credit_code"), ("法定代表人", "legal_representative"),
    ("授权代表", "legal_representative"), ("合同标的", "contract_subject"), ("服务内容", "contract_subject"),
    ("数量", "quantity"), ("质量", "quality"), ("规格", "quality"), ("价款", "price"), ("合同金额", "price"),
    ("税率", "tax_rate"), ("发票", "invoice"), ("付款", "payment_terms"), ("支付", "payment_terms"),
    ("履行期限", "delivery_term"), ("交付期限", "delivery_term"), ("验收标准", "acceptance_standard"),
    ("违约责任", "breach_liability"), ("争议解决", "dispute_resolution"), ("生效条件", "effectiveness_condition"),
]
NO_EVIDENCE_WORDS = ["缺少", "未匹配到有效集团范本", "类型不一致", "引用废止制度", "旧范本"]
RISK_ALIASES = {"待核验": "pending_verification", "待外部数据": "pending_verification", "中": "medium", "高": "high", "低": "low"}
TOOL_LABELS = {
    "model_inference": "模型推理", "knowledge_graph_future": "知识图谱", "enterprise_relation_future": "企业工商数据",
    "internal_master_data_future": "内部主数据", "rule_engine_future": "规则引擎", "rpa_api_future": "RPA/API 查询",
}
FOCUS_SOURCE_RANK = {"user_rule_check": 0, "user_relation_check": 1, "user_external_check": 2, "agent_discovered": 3}
FOCUS_BUCKETS = ["knowledge_base_rule_check", "user_rule_check", "user_relation_check", "user_external_check", "agent_discovered"]
CLAUSE_BUCKETS = ["core", "user_configured", "agent_discovered"]
EXEC_CONFIDENCE = {"hit": 0.92, "not_hit": 0.86, "missing_in_engine": 0.72, "engine_error": 0.58, "not_connected": 0.58}
EXEC_REVIEW = {
    "hit": "建议结合规则引擎返回结果、条款原文和业务单据进一步复核。",
    "not_hit": "本轮规则未命中，但仍建议结合合同上下文确认是否存在边界情况。",
    "missing_in_engine": "请先在规则引擎中补齐该规则，再重新发起分析。",
    "not_connected": "请先接通规则引擎服务，再重新执行这条规则校验。",
    "engine_error": "建议先排查规则引擎服务状态，再重新执行规则校验。",
}
EXEC_REASON = {
    "not_hit": "规则引擎已执行，本轮未命中该规则。",
    "missing_in_engine": "当前审计配置存在，但规则引擎里没有对应 ruleId，这条规则本轮未真正生效。",
    "not_connected": "规则引擎当前未接入，这条规则本轮没有执行。",
}
OVERVIEW_SLOTS = [("合同编号", ["合同编号", "协议编号"]), ("主体摘要", ["主体摘要", "合同基本信息"]), ("甲乙方信息", ["甲乙方信息"]), ("服务内容", ["服务内容"])]
REVIEW_STEPS = ["classify_contract", "match_template", "extract_schema", "compare_template", "retrieve_policy", "run_rules", "generate_issues", "save_report"]
MISSING_VALUES = ["", "未提取", "待提取"]
LIVE_STATUSES = ["effective", "partially_effective"]
TERMINAL_STATUSES = ["abolished", "superseded", "expired"]
OPEN_END = 99991231

# usage profiles: (domain words, any-of keyword groups) in priority order
USAGE_STORAGE = {"occupancy": ["房屋", "移交日", "保证金", "物业", "场地", "承重", "退场", "装修"],
                 "service": ["仓储服务", "入库", "出库", "保管", "存货", "货物", "盘点", "装卸", "仓储费", "发票"],
                 "generic": ["仓储", "保管", "货物"]}
USAGE_STORAGE_RETRIEVAL = {"occupancy": ["房屋", "移交日", "保证金", "物业", "场地", "承重", "退场"],
                           "service": ["仓储服务", "入库", "出库", "保管", "存货", "货物", "盘点", "仓储费", "装卸"],
                           "generic": ["仓储", "保管", "货物"]}
USAGE_SURVEY = ["测量", "测绘", "点云", "激光雷达", "数据采集", "控制测量", "纵横断面", "勘测"]
USAGE_SURVEY_RETRIEVAL = ["测量", "测绘", "点云", "激光雷达", "数据采集", "控制测量", "纵横断面"]
USAGE_TECHNICAL = ["技术服务", "服务成果", "服务费"]
USAGE_TECHNICAL_RETRIEVAL = ["技术服务", "服务费"]
USAGE_AUDIT = ["审计", "审计报告", "注册会计师", "被审计单位", "审计准则"]
USAGE_DESIGN = ["工程勘察", "勘察设计", "设计成果", "图纸", "勘察", "设计任务"]
USAGE_LAB = ["检测", "检验", "试验", "样品", "检测报告"]
USAGE_LEGAL = ["法律服务", "律师", "法律意见", "代理", "诉讼", "仲裁"]
USAGE_NAMES = {
    "occupancy": "场地占用型仓储合同", "service": "标准仓储服务型合同", "storage": "通用仓储合同模板",
    "survey": "测量采集型技术服务模板", "technical": "通用技术服务模板", "audit": "审计鉴证服务型模板",
    "design": "工程勘察设计型模板", "lab": "检测检验服务型模板", "legal": "法律服务型模板", "generic": "通用合同模板",
}

# thresholds
TITLE_WEIGHT, CONTENT_WEIGHT, MATCH_BONUS = 0.65, 0.35, 0.2
MISSING_BELOW, WEAK_BELOW, WEAK_LENGTH_RATIO = 0.42, 0.62, 0.35
# how many characters of a text are compared; None: all
CONTENT_CHARS = EVIDENCE_CHARS = PAGE_CHARS = None
CONTAINED_SCORE, HINT_BONUS, MAX_RUN = 0.95, 0.06, 4
CONFIDENCE_WEIGHTS = (0.32, 0.38, 0.30)
ISSUE_CONFIDENCE = {"template_missing": 0.84, "template_weakened": 0.76, "rule": 0.86}
