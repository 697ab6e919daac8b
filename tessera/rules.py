"""Fixed values the operators default to: the word lists, patterns and thresholds of the domain."""

def renamed(table, names: dict):
    """A routing table, or a map of tool to domains, with its agents renamed."""
    new = lambda v: names.get(v, v) if isinstance(v, str) else v
    if isinstance(table, dict):
        return {k: tuple(map(new, v)) for k, v in table.items()}
    return tuple(tuple(map(new, row)) for row in table)


# Text forms that results depend on.
DOC_TYPES = (("投保须知", "投保须知"), ("费率", "费率表"), ("理赔", "理赔指南"))
DOC_TYPE_DEFAULT = "条款"
SECTION_PATTERNS = (
    r"第[一二三四五六七八九十百千]+章\s*.+",
    r"第\d+条\s*.+",
    r"\d+[\.、]\s*(保险责任|责任免除|释义|犹豫期|续保|宽限期|等待期|免赔额|投保范围|保险金额|保险期间|保险费|保险金申请|保险金给付|合同解除|争议处理)",
)
PRODUCT_FIELDS = {
    "产品名称": r"产品名称[：:]\s*(.+)",
    "保险公司": r"([一-龥]{2,6})保险(?:股份)?有限公司",
    "备案号": r"(?:备案号|产品备案编号)[：:]\s*(.+)",
    "等待期": r"等待期[为是]?\s*(\d+)\s*[日天]",
    "犹豫期": r"犹豫期[为是]?\s*(\d+)\s*[日天]",
    "保障期间": r"(?:保障期间|保险期间)[为是]?\s*(.+?)(?:[，。]|$)",
    "投保年龄": r"投保年龄[为是：:]*\s*(.+?)(?:[，。]|$)",
}
CHUNK_DELIMS, SEGMENT_DELIMS = "。！？；\n", "。！？\n"
HEADER = r"^第[一二三四五六七八九十百千\d]+[章节条]"
NORMALIZE_DROP = "[，。！？、；：'（）\\s]"

# Domain guard.
DOMAIN_WORDS = (
    "医疗险", "重疾险", "意外险", "寿险", "车险", "年金险", "百万医疗", "防癌险", "门诊险", "旅行险", "家财险",
    "定期寿险", "终身寿险", "两全险", "教育金", "养老险",
    "投保", "续保", "退保", "理赔", "报案", "核保", "加保", "保费", "保额", "免赔额", "等待期", "犹豫期", "现金价值",
    "健康告知", "除外责任", "保险责任", "条款", "保障", "赔付", "报销", "给付", "津贴", "补偿",
    "住院", "门诊", "手术", "确诊", "意外", "身故", "伤残", "疾病", "治疗", "药品", "检查",
    "平安", "众安", "太平洋", "人保", "太平", "阳光", "泰康", "新华", "友邦", "招商信诺",
)
BLOCK_WORDS = ("天气", "股票", "基金", "游戏", "外卖", "快递", "电影", "音乐", "编程", "代码", "服务器")
INTERNAL_ROLES = ("agent", "underwriter", "admin")

# Intent rules in order, thresholds, sets.
INTENT_RULES = {
    "条款解读": ("条款", "保障范围", "保什么", "不保什么", "免责", "等待期", "犹豫期", "免赔额", "赔付比例", "报销范围", "续保条件", "健康告知"),
    "保单查询": ("我的保单", "保单号", "保单状态", "查看保单", "查保单", "保单信息"),
    "理赔咨询": ("理赔", "报销", "赔付", "报案", "理赔进度", "理赔材料", "怎么赔", "能赔吗", "赔多少"),
    "产品对比": ("对比", "比较", "哪个好", "哪个划算", "区别", "vs", "PK"),
    "保费试算": ("多少钱", "保费", "费用", "价格", "试算", "一年多少", "每月多少"),
    "退保咨询": ("退保", "退保险", "不想保了", "取消", "退多少钱", "现金价值"),
    "投诉建议": ("投诉", "举报", "不满意", "态度差", "建议", "反馈"),
}
INTENT_THRESHOLDS = {
    "条款解读": 0.50, "保单查询": 0.60, "理赔咨询": 0.50, "产品对比": 0.55, "保费试算": 0.60,
    "退保咨询": 0.55, "投诉建议": 0.70, "闲聊寒暄": 0.70, "out_of_domain": 0.40,
}
COMPLEX_INTENTS = ("理赔咨询", "产品对比", "核保咨询")
TRIVIAL_INTENTS = ("闲聊寒暄", "投诉建议")
CORE_WORDS = (
    "投保", "续保", "退保", "理赔", "核保", "保费", "保额", "条款", "保障", "免赔", "等待期", "犹豫期", "赔付",
    "医疗险", "重疾险", "意外险", "寿险", "车险", "住院", "门诊", "手术", "确诊", "平安", "众安", "太平洋", "人保", "e生保",
)
QUALITY_THRESHOLDS = {"理赔咨询": (0.60, 0.45), "产品对比": (0.50, 0.35)}
QUALITY_DEFAULT = (0.55, 0.40)
INSURERS = ("平安", "众安", "太平洋", "人保", "太平", "阳光", "泰康", "新华", "友邦")
PRODUCT_PATTERN = r"([一-龥a-zA-Z]{2,10}(?:保|生|e生|尊享|守护|医疗|重疾))"
PRODUCT_PATTERN_SHORT = r"([一-龥a-zA-Z]{2,10}(?:保|生|e生|尊享|守护))"
EVENT_WORDS = ("住院", "手术", "门诊", "急诊", "ICU", "重症监护", "放化疗", "透析", "器官移植")
GRAPH_EVENT_WORDS = (*EVENT_WORDS, "康复治疗", "中医治疗")
DIMENSIONS = (
    ("等待期", r"(等待期|犹豫期|宽限期)"),
    ("免赔额", r"(免赔额|起付线|自付比例|自费)"),
    ("保费", r"(保费|费率|多少钱|一年多少|每月多少|价格)"),
    ("保障范围", r"(保障范围|保险责任|保什么|覆盖)"),
    ("续保", r"(续保|续费|保证续保|自动续费)"),
    ("健康告知", r"(健康告知|核保|告知义务|如实告知|既往症)"),
    ("理赔", r"(理赔|赔付|报销|能赔|赔多少|理赔流程|理赔材料)"),
    ("退保", r"(退保|退保险|现金价值|犹豫期退保)"),
)
PRODUCT_TYPES = ("百万医疗", "重疾险", "意外险", "定期寿险", "医疗险")
WAITING_ASKED = {"strict": r"等待期[不超≤少于]{1,2}\s*(\d+)\s*[天日]", "fixed": r"等待期(?:不超过|不多于|少于|≤)\s*(\d+)\s*[天日]"}
DEDUCTIBLE_ASKED = {"strict": r"免赔额[不超≤少于]{1,2}\s*(\d+)\s*([万元])", "fixed": r"免赔额(?:不超过|不多于|少于|≤)\s*(\d+)\s*([万元])"}

# Routing. The names of agents are those of this library; renamed() gives tables with others.
ROUTES = (
    ("产品咨询", "product", "service", "multi_agent"), ("产品对比", "product", "service", "multi_agent"),
    ("保费试算", "product", "service", "multi_agent"), ("投保流程", "product", "risk", "multi_agent"),
    ("核保咨询", "risk", "product", "multi_agent"), ("理赔咨询", "claim", "risk", "multi_agent"),
    ("理赔进度", "claim", "service", "multi_agent"), ("条款解读", "claim", "product", "multi_agent"),
    ("保单查询", "service", "product", "multi_agent"), ("投诉建议", "service", None, "rag_fallback"), ("闲聊寒暄", "service", None, "rag_fallback"),
)
SECONDARY_INTENTS = (
    ("投保流程", "risk", "核保咨询"), ("理赔咨询", "risk", "核保咨询"), ("理赔进度", "service", "保单查询"),
    ("产品咨询", "service", "保单查询"), ("产品对比", "service", "保单查询"), ("保费试算", "service", "保单查询"),
    ("核保咨询", "product", "产品咨询"), ("条款解读", "product", "产品咨询"), ("保单查询", "product", "产品咨询"),
)
TOOL_ROLES = {
    "policy_query": ("customer", "agent", "underwriter"), "claim_eligibility": ("agent", "underwriter"), "clause_search": ("customer", "agent", "underwriter"),
    "premium_calc": ("agent", "underwriter"), "product_compare": ("customer", "agent"), "claim_tracking": ("customer", "agent"), "human_handoff": ("agent", "underwriter"),
}
TOOL_DOMAINS = {
    "product_compare": ("product",), "premium_calc": ("product", "claim"), "policy_query": ("claim", "service"), "clause_search": ("claim", "product", "risk"),
    "claim_eligibility": ("claim",), "claim_tracking": ("claim",), "human_handoff": ("claim", "product", "risk", "service"),
}
STAGE_PLANS = {
    0: ("faq", "chitchat"),
    1: ("classify", "cache", "retrieval", "generate", "compliance"),
    2: ("classify", "cache", "kg", "strategy", "retrieval", "quality", "generate", "compliance", "cache_write"),
}

# Compliance.
MEDICAL_WORDS = ("医生", "就医", "服药", "用药", "治疗")
ADVICE_WORDS = ("建议", "推荐", "应该", "最好")
QUOTING_WORDS = ("根据条款", "条款规定")
REGULATORY_WORDS = (
    "保证理赔", "一定能赔", "肯定可以赔", "肯定赔", "100%能理赔", "绝对不会拒赔", "无条件赔付",
    "保本保息", "稳赚不赔", "最好的保险", "最便宜的", "保证承保", "一定承保", "肯定能买",
)
DENIGRATION = (
    r"不推荐.{0,10}(平安|众安|太平洋|人保|太平|阳光|泰康|新华|友邦)",
    r"(平安|众安|太平洋|人保|太平|阳光|泰康|新华|友邦).{0,10}(不好|坑|骗|差|垃圾|不靠谱)",
    r"千万别买.{0,10}(平安|众安|太平洋|人保|太平|阳光|泰康|新华|友邦)",
)
AMOUNTS = (r"\d+元", r"\d+万", r"\d+%", r"百分之[一-龥]+", r"免赔额", r"赔付比例", r"保额")
CITATIONS = (r"根据条款", r"条款第[\d.]+条", r"依据.*?规定", r"保险合同约定", r"条款.*?明确")
CITED_INTENTS = ("理赔咨询", "保费试算")
DENIGRATION_CUT = r"(不推荐|千万别买).{0,20}"

# Seed graph.
DISEASES = {
    "呼吸系统": ("肺炎", "支气管炎", "哮喘", "慢阻肺", "肺结核", "肺癌", "肺气肿", "上呼吸道感染", "流感", "新冠", "咳嗽", "感冒", "发烧", "咽炎"),
    "心血管": ("高血压", "冠心病", "心肌梗死", "心绞痛", "心力衰竭", "心律失常", "心脏瓣膜病", "动脉硬化", "高血脂", "中风", "脑梗", "脑出血"),
    "消化系统": ("胃炎", "胃溃疡", "阑尾炎", "胆囊炎", "胆结石", "胰腺炎", "肝炎", "肝硬化", "结肠炎", "肠梗阻", "痔疮", "胃癌", "肝癌"),
    "骨骼关节": ("骨折", "关节炎", "骨质疏松", "颈椎病", "腰椎间盘突出", "半月板损伤", "韧带撕裂", "痛风", "意外骨折", "扭伤"),
    "泌尿生殖": ("肾炎", "肾结石", "尿路感染", "前列腺增生", "子宫肌瘤", "卵巢囊肿", "宫颈炎", "乳腺增生", "乳腺癌"),
    "内分泌": ("糖尿病", "甲亢", "甲减", "甲状腺结节", "肥胖症"),
    "神经系统": ("癫痫", "帕金森", "阿尔茨海默", "偏头痛", "抑郁症", "焦虑症"),
    "眼科": ("白内障", "青光眼", "近视手术", "视网膜脱落"),
    "皮肤": ("湿疹", "荨麻疹", "银屑病", "带状疱疹"),
    "意外伤害": ("意外摔伤", "交通事故", "烧伤", "烫伤", "溺水", "中毒", "触电"),
    "传染": ("肺炎", "肝炎", "结核", "流感", "新冠", "水痘", "麻疹"),
    "肿瘤": ("肺癌", "肝癌", "胃癌", "乳腺癌", "甲状腺癌", "结肠癌", "白血病", "淋巴瘤", "良性肿瘤", "恶性肿瘤"),
    "妊娠分娩": ("顺产", "剖腹产", "流产", "宫外孕", "孕期检查"),
    "先天遗传": ("先天性心脏病", "唇腭裂", "血友病", "色盲"),
}
INSURER_ALIASES = {
    "平安": "平安健康", "众安": "众安保险", "太平洋": "太平洋保险", "人保": "中国人保", "太平": "太平人寿",
    "阳光": "阳光保险", "泰康": "泰康在线", "新华": "新华保险", "友邦": "友邦保险", "国寿": "中国人寿",
}
WAITING_PATTERN = r"等待期[为是]?\s*(\d+)\s*[天日]"
DEDUCTIBLE_PATTERNS = (r"免赔额[为是]?\s*(\d+)\s*万\s*元?", r"免赔额[为是]?\s*(\d+)\s*元", r"免赔[为是]?\s*(\d+)\s*万", r"年免赔额\s*(\d+)\s*万")
EXCLUSION_CLAUSES = ("责任免除", "免责条款", "除外责任")
