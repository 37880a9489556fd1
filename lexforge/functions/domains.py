"""Subject domains and their keywords."""

# Results depend on every entry, on the order of the domains (ties) and on the lists' lengths.
# "API" never occurs in lower-cased text; it still counts in its list's length.
DOMAIN_KEYWORDS: dict[str, list[str]] = {
    "legal": [
        "contract", "agreement", "party", "clause", "liability", "warranty", "termination", "jurisdiction", "arbitration", "indemnify", "pursuant", "hereto", "furnish",
        "合同", "协议", "条款", "责任", "仲裁", "赔偿", "法律", "法院", "诉讼",
    ],
    "medical": [
        "patient", "diagnosis", "treatment", "symptom", "surgery", "clinical", "pharmaceutical", "dosage", "therapy",
        "患者", "诊断", "治疗", "手术", "药物", "临床", "症状", "疾病",
    ],
    "finance": [
        "revenue", "asset", "liability", "equity", "dividend", "portfolio", "securities", "audit", "fiscal",
        "财务", "资产", "负债", "股东", "审计", "税务", "收入", "投资",
    ],
    "it": [
        "software", "hardware", "database", "API", "server", "algorithm", "deployment", "framework", "interface",
        "软件", "硬件", "数据库", "服务器", "算法", "接口", "系统", "编程",
    ],
    "academic": [
        "hypothesis", "methodology", "analysis", "conclusion", "abstract", "citation", "empirical", "theoretical",
        "研究", "方法", "分析", "结论", "摘要", "实证", "理论", "实验",
    ],
}
DOMAINS = list(DOMAIN_KEYWORDS)
