"""Fixed values that decide results: word lists, aliases, ordinals and patterns, in their order of
precedence (the first match wins)."""

from __future__ import annotations

# Punctuation and what it is folded to, place by place.
PUNCTUATION = "（）【】“”‘’，；：—－／、"
PLAIN = "()[]\"\"'',;:--//"

# Canonical skills with their aliases.
SKILLS = {
    "人工智能": ["人工智能", "ai", "人工智能算法"], "机器学习": ["机器学习", "machine learning", "ml", "机器学习模型"], "深度学习": ["深度学习"],
    "大模型": ["大模型", "llm", "openai", "国内大模型"], "Agent": ["agent", "agents"], "NLP": ["nlp", "文本分类", "实体识别"],
    "计算机视觉": ["计算机视觉", "cv", "图像处理", "图像识别", "图像分割", "医学影像处理", "图像配准"], "Python": ["python"], "Java": ["java"], "C++": ["c++"],
    "SQL": ["sql"], "MySQL": ["mysql"], "Redis": ["redis"], "Docker": ["docker"], "Linux": ["linux"], "TensorFlow": ["tensorflow"], "PyTorch": ["pytorch"],
    "MATLAB": ["matlab"], "JavaScript": ["javascript"], "HTML/CSS": ["html", "css"], "API": ["api"], "自动化": ["自动化", "plc"],
    "算法开发": ["算法开发", "算法", "模型训练", "调优"], "数据分析": ["数据分析", "大数据"],
    "软件工程": ["软件工程", "系统架构", "技术选型", "需求分析", "数据结构", "编程语言", "编程", "调试", "测试"], "物联网": ["物联网", "智能制造"],
    "机器人": ["机器人", "具身机器人"], "医学AI": ["医疗", "医学", "生物医学工程", "医疗信息化"],
}

# Tags that are no keywords.
STOP_KEYWORDS = (
    "计算机 计算机科学 数学 电子 电子信息 管理 销售 营销 英语 技术交流 方案设计 项目管理 团队建设 团队管理 技术文档 需求调研 指导 方向 产品 专家 工程师 高级 研发 开发 技术研究 解决方案"
).split()

# Canonical cities with their aliases.
CITIES = {
    "北京": ["北京市"], "上海": ["上海市", "上海-浦东", "上海-浦东新区", "上海浦东", "上海浦东新区"], "深圳": ["深圳市"], "广州": ["广州市"], "杭州": ["杭州市"],
    "成都": ["成都市"], "南京": ["南京市"], "武汉": ["武汉市"], "宜昌": ["宜昌市"], "远程办公": ["远程", "remote", "居家办公"],
}

# Canonical industries with their aliases.
INDUSTRIES = {
    "电子/半导体/集成电路": ["电子技术/半导体/集成电路"], "通信/电信": ["通信/电信/网络设备", "通信/电信运营、增值服务"],
    "计算机软件/服务": ["计算机软件", "计算机服务"], "专业服务(咨询/人力资源/财会)": ["专业服务(咨询、人力资源、财会)"],
}

# Canonical benefits with their aliases.
BENEFITS = {
    "五险一金": ["全额五险一金"], "六险一金": [], "补充医疗保险": ["医疗保险", "子女医疗保险"], "带薪年假": [], "带薪病假": [], "年终奖金": ["年终奖"], "绩效奖金": [],
    "项目奖金": [], "股票期权": [], "定期体检": ["体检"], "员工旅游": [], "专业培训": ["培训"], "交通补贴": [], "通讯补贴": [], "餐饮补贴": ["有餐补", "餐补"],
    "周末双休": ["双休"], "免费班车": [], "弹性工作": [], "节日福利": ["法定节假"], "零食下午茶": ["下午茶"], "工伤保险": [], "公积金": [], "社保": [], "包住": [],
    "包吃住": [], "出差补贴": [], "晋升空间大": [], "底薪": [], "提成": [], "大小周": [],
}

# Legal endings of company names, in the order in which they are tried.
LEGAL_ENDINGS = ["股份有限公司", "有限责任公司", "有限公司", "集团有限公司", "集团股份有限公司", "集团"]
# Ordinals of degrees, higher ones first where a text holds several.
DEGREES = {"不限": 0, "大专": 1, "本科": 2, "硕士": 3, "博士": 4}

# What the rule-based recognizer looks for.
NER_SKILLS = [
    "Python", r"C\+\+", "C#", "Java", "JavaScript", "TypeScript", "Go", "Rust", "SQL", "R", "MATLAB", "Scala", "Kotlin", "Swift", "TensorFlow", "PyTorch", "Keras", "Scikit-learn",
    "Pandas", "NumPy", "JAX", "MXNet", "PaddlePaddle", "ONNX", "OpenCV", "机器学习", "深度学习", "自然语言处理", "计算机视觉", "数据挖掘", "推荐系统", "强化学习", "预测模型",
    "大模型", "LLM", "NLP", "AIGC", "Stable Diffusion", "ChatGPT", "Transformer", "BERT", "GPT", "GAN", "RNN", "CNN", "LSTM", "注意力机制", "多传感器融合", "BEV", "SLAM", "VIO",
    "SFM", "3D视觉", "Lidar", "Radar", "激光雷达", "毫米波雷达", "超声波传感器", "前视", "环视鱼眼", "目标检测", "目标跟踪", "语义分割", "后处理算法", "融合算法", "路径规划", "行为预测",
    "Spark", "Hadoop", "Flink", "Kafka", "Hive", "HBase", "Docker", "Kubernetes", "K8s", "AWS", "Azure", "GCP", "ROS", "ROS2", "Gazebo", "Simulink", "CANoe", "CANape", "FreeRTOS",
    "AUTOSAR", "功能安全", "ISO 26262", "ASPICE", "Linux", "Git", "SVN", "Jenkins", "JIRA", "Confluence", "CUDA", "TensorRT", "DeepStream", "沟通能力", "团队合作", "项目管理",
    "英语读写", "英语口语",
]
NER_EDUCATION = ["博士", "硕士", "本科", "研究生", "大专", "博士后", "MBA", "EMBA", "Ph.D", "Master", "Bachelor"]
NER_MAJORS = ["计算机科学", "软件工程", "计算机视觉", "人工智能", "自动化", "电子工程", "通信工程", "机械工程", "数学", "统计学", "模式识别", "机器人", "控制工程", "电子信息", "车辆工程"]
NER_DUTY_VERBS = ["负责", "参与", "主导", "设计", "开发", "优化", "维护", "搭建", "管理", "实现", "完成", "建设"]

# Names of degrees and majors that the entity disambiguation brings together.
NED_DEGREES = {
    "硕士": "硕士", "硕士研究生": "硕士", "研究生": "硕士", "博士": "博士", "博士研究生": "博士", "phd": "博士", "本科": "本科", "大学本科": "本科", "学士": "本科", "bachelor": "本科",
    "大专": "大专", "专科": "大专", "高中": "高中", "中专": "中专",
}
NED_MAJORS = {
    "计算机科学": "计算机科学与技术", "计算机科学与技术": "计算机科学与技术", "计算机": "计算机科学与技术", "计算机技术": "计算机科学与技术", "软件工程": "软件工程", "人工智能": "人工智能",
    "电子信息": "电子信息工程", "电子信息工程": "电子信息工程", "电子工程": "电子信息工程", "通信工程": "通信工程", "通信": "通信工程", "自动化": "自动化", "数学": "数学", "应用数学": "数学",
    "物理学": "物理学", "物理": "物理学", "统计学": "统计学", "统计": "统计学", "机械工程": "机械工程", "机械": "机械工程", "电气工程": "电气工程", "电气": "电气工程", "数据科学": "数据科学",
    "图像处理": "计算机视觉", "计算机视觉": "计算机视觉", "信号处理": "信号与信息处理", "信号与信息处理": "信号与信息处理", "生物医学工程": "生物医学工程", "声学": "声学",
    "微电子": "微电子学", "微电子学": "微电子学", "控制工程": "控制科学与工程", "控制科学与工程": "控制科学与工程",
}

# Relations of an entity's type in the entity graph; all others are RELATED_TO.
ENTITY_RELATIONS = {
    "COMPANY": "BELONGS_TO_COMPANY", "DEPARTMENT": "BELONGS_TO_DEPT", "LOCATION": "LOCATED_IN", "BENEFIT": "PROVIDES_BENEFIT", "RESPONSIBILITY": "HAS_RESPONSIBILITY",
    "SKILL": "REQUIRE_SKILL", "MAJOR": "REQUIRE_MAJOR", "DEGREE": "REQUIRE_DEGREE", "WORKTIME": "REQUIRE_WORKTIME",
}
# Triggers of relations between two entities, in the order in which they are tried.
TOGETHER = r"(?:、|/|和|与|及|以及|,|，|\s+)"
INCLUDES = "(?:包括但不限于|包括|包含|涵盖|如|比如|分为|：|:)"
INCLUDED = "(?:等|等相关|等基础)"
APPLIES = "(?:用于|进行|实现|支撑|赋能|提升|开发|处理)"
