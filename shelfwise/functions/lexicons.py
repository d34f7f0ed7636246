"""Term lists and lookup tables.

Everything here is a fixed value: results only agree with the published
contracts if these words, weights and hosts are exactly these.  Every operator
takes its lists as parameters, so the same code runs with other languages.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: names in published records
WEB_SOURCE = "web-learning-search"
LINK_SOURCE = "generic-web-source"
LOCAL_SOURCE = "local-library-search"
WEB_SOURCE_NAME = "网页搜索"
LINK_SOURCE_NAME = "通用网页来源"
LOCAL_SOURCE_NAME = "本地学习资料库"
LOCAL_PROVIDER = "本地资料库"
UNTITLED_LINK = "未命名资源"
NEXT_ROUTES = "route-map"
NEXT_DETAILS = "candidates-from-detail"
NEXT_SEARCH = "search-resources"
NEXT_ANALYSIS = "learning-resource-analyzer"
NEXT_DEEPER = "profile_deeper"
TEXTBOOK_COMMAND = "textbook-candidates"

# ---------------------------------------------------------------- fixed values: search results
WEB_RISK_TERMS = ["下载器", "高速下载", "破解", "破解版", "成人", "博彩", "贷款", "注册机"]
OFFICIAL_HINTS = ["edu.cn", "gov.cn", "moe.gov.cn", "smartedu.cn", "cbern.com.cn", "人民教育出版社", "出版社"]
AUTH_WALL_TERMS = ["登录", "会员", "付费", "购买"]
WEB_TYPE_RULES = [
    ("习题", ["练习", "习题", "作业", "可打印"]),
    ("试卷", ["试卷", "测试题", "单元测试"]),
    ("课件", ["课件", "ppt", "pptx"]),
    ("视频", ["视频", "网课", "讲解视频"]),
    ("音频", ["音频", "朗读", "儿歌", "mp3"]),
    ("图片", ["图片", "图卡", "卡片"]),
    ("绘本", ["绘本"]),
    ("百科文章", ["百科", "科普", "知识"]),
    ("讲义", ["讲义", "教案", "素材"]),
]
WEB_TYPE_BY_FORMAT = {
    "video": "视频", "audio": "音频", "image": "图片", "ppt": "课件", "pptx": "课件",
    "pdf": "文档", "doc": "文档", "docx": "文档",
}
# (subject, domain, terms); a null subject means only the domain is known.
WEB_SUBJECT_RULES = [
    ("数学", "数学", ["数学", "四则", "运算", "分数"]),
    ("语文", "文学", ["语文", "拼音", "识字", "唐诗", "宋词", "成语"]),
    ("英语", "英语", ["英语", "英文", "自然拼读"]),
    (None, "百科", ["百科", "恐龙", "宇宙", "动物", "人体"]),
]
FORMAT_WORD_RULES = [
    ("video", ["视频", "video", "bilibili", "youku"]),
    ("audio", ["音频", "朗读", "mp3", "audio"]),
    ("image", ["图片", "image"]),
]

# ---------------------------------------------------------------- fixed values: page links
LINK_TYPE_RULES = [
    ("教材", ["教材", "教科书", "课本"]),
    ("习题", ["练习", "习题", "作业", "可打印"]),
    ("试卷", ["试卷", "测试题", "单元测试"]),
    ("课件", ["课件", "ppt", "pptx"]),
    ("视频", ["视频", "网课", "讲解", "mp4"]),
    ("音频", ["音频", "朗读", "儿歌", "故事", "mp3"]),
    ("图片", ["图片", "图卡", "卡片"]),
    ("百科文章", ["百科", "科普", "知识"]),
    ("讲义", ["讲义", "教案", "素材"]),
]
LINK_TYPE_BY_FORMAT = {
    "ppt": "课件", "pptx": "课件", "mp4": "视频", "mov": "视频", "avi": "视频",
    "mp3": "音频", "wav": "音频", "m4a": "音频", "jpg": "图片", "png": "图片",
    "webp": "图片", "gif": "图片", "zip": "压缩包", "rar": "压缩包", "7z": "压缩包",
}
LINK_SUBJECT_RULES = [
    ("数学", "数学", ["数学", "四则", "运算", "分数", "加减乘除"]),
    ("语文", "文学", ["语文", "拼音", "识字", "唐诗", "宋词", "成语"]),
    ("英语", "英语", ["英语", "英文", "自然拼读"]),
    (None, "百科", ["百科", "科普", "宇宙", "恐龙"]),
    (None, "音乐", ["儿歌", "音乐", "节奏"]),
]
LINK_AUTH_TERMS = ["登录", "会员", "付费", "授权", "购买", "token", "accessToken", "Authorization"]
LINK_OFFICIAL_HINTS = ["edu.cn", "gov.cn", "moe.gov.cn", "smartedu.cn", "cbern.com.cn", "出版社"]
LINK_EXTENSIONS = [
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "jpg", "jpeg", "png", "webp", "gif",
    "mp3", "wav", "m4a", "mp4", "mov", "avi", "zip", "rar", "7z",
]

# ---------------------------------------------------------------- fixed values: page profile
PROFILE_EXTENSIONS = [
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "jpg", "jpeg", "png", "webp", "gif",
    "mp3", "wav", "m4a", "mp4", "mov", "zip",
]
SITE_EXTENSIONS = [
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "json", "srt", "superboard", "jpg", "jpeg",
    "png", "webp", "gif", "mp3", "wav", "m4a", "mp4", "mov", "m3u8", "zip", "rar", "7z",
]
API_TERMS = [
    "api", "search", "resource", "resources", "content", "catalog", "course", "lesson", "detail", "graphql", "ndrs",
]
SITE_API_TERMS = [
    "api", "resources", "resource", "librarylist", "details", "search", "aggregate", "combine", "ndrv2",
    "catalog", "course", "lesson", "content",
]
PROFILE_AUTH_TERMS = ["登录", "会员", "付费", "授权", "购买", "accessToken", "Authorization", "token"]
PAGINATION_TERMS = ["下一页", "上一页", "分页", "page=", "pageNo", "pageIndex", "cursor", "offset"]
DETAIL_TERMS = ["detail", "详情", "course", "resource", "content", "lesson"]
LISTING_TERMS = ["detail", "course", "resource", "page=", "list"]
PROFILE_RISK_TERMS = ["下载器", "破解", "成人", "博彩", "贷款", "注册机"]
PROFILE_ARTICLE_TERMS = ["如何", "方法", "指南", "介绍", "科普"]
MEDIA_TERMS = ["视频"]
PROFILE_TYPE_RULES = [
    ("教材", ["教材", "教科书", "课本"]),
    ("习题", ["练习题", "习题", "作业"]),
    ("试卷", ["试卷", "测试题"]),
    ("课件", ["课件", "ppt", "pptx"]),
    ("视频", ["视频", "网课", "播放"]),
    ("音频", ["音频", "朗读", "儿歌"]),
    ("百科文章", ["百科", "科普", "知识"]),
]
SITE_TYPE_SCORE = {
    "static_resource_page": "7.0", "resource_listing": "6.5", "spa_app": "7.5",
    "media_page": "6.0", "article_page": "3.0", "unknown": "2.0",
}

# ---------------------------------------------------------------- fixed values: source discovery
RESOURCE_TERMS = [
    "资源", "资料", "下载", "课件", "ppt", "pdf", "doc", "练习题", "习题", "试卷", "教案", "讲义", "素材", "电子教材",
]
DIRECT_FORMATS = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "mp3", "wav", "m4a", "mp4", "mov", "zip"]
VIDEO_TERMS = ["视频", "播放", "课程", "网课", "m3u8", "bilibili", "youku", "腾讯视频"]
ARTICLE_TERMS = ["如何", "方法", "经验", "指南", "介绍", "百科", "知识", "科普"]
SOURCE_RISK_TERMS = ["下载器", "高速下载", "破解", "破解版", "成人", "博彩", "贷款", "注册机", "网盘提取码"]
OFFICIAL_HOST_HINTS = ["edu.cn", "gov.cn", "moe.gov.cn", "smartedu.cn", "cbern.com.cn", "eduyun.cn"]
DISCOVERY_TYPE_RULES = [
    ("教材", ["教材", "课本", "教科书"]),
    ("习题", ["练习题", "习题", "作业", "可打印"]),
    ("试卷", ["试卷", "测试题"]),
    ("课件", ["课件", "ppt", "pptx"]),
    ("视频", ["视频", "网课", "讲解"]),
    ("音频", ["音频", "朗读", "儿歌"]),
    ("百科文章", ["百科", "科普", "知识"]),
]
DISCOVERY_FORMAT_RULES = [
    ("image", ["图片", "jpg", "png", "webp"]),
    ("video", ["视频", "m3u8", "mp4"]),
    ("audio", ["音频", "mp3", "朗读"]),
]
SOURCE_BASE_SCORE = {
    "known_source": "8.0", "resource_site": "6.5", "resource_page": "6.0", "video_page": "5.5",
    "article_page": "3.5", "unknown": "2.5", "download_risk": "0.0",
}
# (host part, path part, adapter, reason); the first that fits wins.
KNOWN_SOURCES = [
    ("basic.smartedu.cn", "/tchMaterial", "smartedu-resources", "国家中小学智慧教育平台站内教材资源入口"),
    ("basic.smartedu.cn", "/syncClassroom", "smartedu-resources", "国家中小学智慧教育平台同步课堂入口"),
    ("basic.smartedu.cn", "", "smartedu-resources", "国家中小学智慧教育平台通用入口"),
]

# ---------------------------------------------------------------- fixed values: content evidence
ANALYSIS_RISK_TERMS = [
    "下载器", "高速下载", "破解", "破解版", "成人", "博彩", "贷款", "注册机", "付费", "会员", "登录",
]
AUTH_PAGE_TERMS = ["请登录", "登录后", "会员专享", "开通会员", "无权限", "403", "access denied", "forbidden"]
KEYWORDS = [
    "数学", "四则", "运算", "练习", "可打印", "恐龙", "百科", "唐诗", "宋词", "儿歌", "视频", "音频", "课件",
    "识字", "拼音", "自然拼读", "绘本", "科学", "实验", "宇宙",
]
KIND_FORMATS = {
    "document": ["pdf", "doc", "docx", "ppt", "pptx", "txt"],
    "webpage": ["html", "webpage"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "image"],
    "audio": ["mp3", "wav", "m4a", "aac", "flac", "audio"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "video"],
}

# ---------------------------------------------------------------- fixed values: ranking
SUSPICIOUS_TERMS = ["破解", "成人", "博彩", "贷款", "下载器", "高速下载", "注册机", "破解版", "性感"]
ANALYSIS_ALARM_TERMS = ["登录", "权限", "付费", "格式与实际内容不一致"]
TRUST_TERMS = ["国家", "教育", "出版社", "官方", "智慧教育"]
PRINTABLE_FORMATS = ["pdf", "doc", "docx", "ppt", "pptx", "jpg", "jpeg", "png"]
AUDIO_FORMATS = ["mp3", "wav", "m4a", "aac", "flac", "audio"]
VIDEO_FORMATS = ["mp4", "mov", "avi", "mkv", "webm", "video"]
SCORE_CAPS = {
    "relevance": 30, "age_fit": 20, "authority": 15, "accessibility": 10, "format_fit": 10, "safety": 10,
    "metadata_quality": 5,
}
QUALITY_LEVELS = [("excellent", 90), ("high", 75), ("medium", 60), ("low", 40), ("reject", 0)]
RECOMMENDATION = {
    "excellent": "strong_recommend", "high": "recommended", "medium": "backup", "low": "not_preferred",
    "reject": "reject",
}
SKIP_RISK_TERMS = ["下载器", "破解", "成人"]

# ---------------------------------------------------------------- fixed values: local search
FORMAT_FAMILIES = {
    "pdf": ["pdf"], "doc": ["doc", "docx"], "docx": ["doc", "docx"], "docdocx": ["doc", "docx"],
    "ppt": ["ppt", "pptx"], "pptx": ["ppt", "pptx"], "pptpptx": ["ppt", "pptx"],
    "image": ["image", "jpg", "jpeg", "png", "gif", "webp"], "图片": ["image", "jpg", "jpeg", "png", "gif", "webp"],
    "audio": ["audio", "mp3", "wav", "m4a"], "音频": ["audio", "mp3", "wav", "m4a"],
    "video": ["video", "mp4", "mov", "avi"], "视频": ["video", "mp4", "mov", "avi"],
}

# ---------------------------------------------------------------- fixed values: library
BLOCKED_SUFFIXES = ["json", "log", "tmp", "manifest"]
LIBRARY_FORMATS = [
    "jpg", "png", "gif", "webp", "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "mp3", "wav", "m4a",
    "mp4", "mov", "avi", "zip", "html",
]
LIBRARY_DOMAIN_RULES = [
    ("数学", ["数学", "计算", "四则", "口算", "应用题", "几何"]),
    ("语文", ["语文", "拼音", "识字", "阅读", "作文", "唐诗", "宋词", "古诗"]),
    ("英语", ["英语", "单词", "phonics", "自然拼读"]),
    ("科学", ["科学", "百科", "实验", "恐龙", "宇宙", "动物", "植物"]),
    ("音乐", ["儿歌", "音乐", "朗读", "童谣"]),
    ("艺术", ["美术", "绘画", "手工", "艺术"]),
]
# (class, placeholder, points in hundredths when the placeholder is not needed)
LIBRARY_CLASSES = [
    ("stage_or_age", "未分学段", 16),
    ("grade_or_phase", "未分年级", 12),
    ("domain_or_subject", "综合", 16),
    ("topic_or_type", "未分主题", 14),
    ("source_or_version", "未分来源", 10),
]
DEFAULT_TYPE = "资料"
REVIEW_FOLDER = "待确认"
PLACEHOLDERS = {
    "stage": ["未分学段", "未分适龄"], "grade": ["未分年级", "未分阶段"], "subject": ["综合"],
    "topic": ["未分主题"], "version": ["未分来源"],
}

# ---------------------------------------------------------------- fixed values: site catalog and details
TAG_DIMENSIONS = {"zxxxd": "stage", "zxxxk": "subject", "zxxnj": "grade", "zxxbb": "version", "zxxcc": "volume"}
SITE_URL = "https://basic.smartedu.cn/"
SITE_NAME = "国家中小学智慧教育平台"
SITE_SOURCE = "smartedu-resources"
SITE_UNTITLED = "SmartEdu 资源"
SITE_SEARCH_PREFIX = "smartedu-search:"
SITE_AUTH_WARNING = "可能需要 SmartEdu 登录授权"
DETAIL_FOLDER = "https://{server}.ykt.cbern.com.cn/zxx/ndrv2/"
FILE_SERVERS = ["s-file-1", "s-file-2", "s-file-3"]
PRIVATE_HOST = "https://r1-ndr-private.ykt.cbern.com.cn"
PRIVATE_HOST_PATTERN = r"https://r[123]-ndr-private\.ykt\.cbern\.com\.cn"
PUBLIC_HOSTS = [
    "https://r1-ndr.ykt.cbern.com.cn", "https://r2-ndr.ykt.cbern.com.cn", "https://r3-ndr.ykt.cbern.com.cn",
]
STORAGE_PREFIX = "cs_path:${ref-path}"
CATALOG_TABS = {
    "qualityCourse": "qualityCourse", "prepare_lesson": "prepareLesson", "prepareLesson": "prepareLesson",
    "questions": "questions", "question": "questions", "examinationPapers": "examinationPapers",
    "teachingKnMicroLesson": "teachingKnMicroLesson", "experiment": "experiment", "syncClassroom": "qualityCourse",
}
DEFAULT_TAB = "sedu"
TEXTBOOK_CATALOG = "tchMaterial"
DETAIL_TYPE_BY_FORMAT = {
    "课件": ["ppt", "pptx"],
    "图片": ["jpg", "png", "webp", "gif", "bmp"],
    "文档": ["pdf", "doc", "docx", "txt", "xls", "xlsx"],
    "字幕": ["srt", "vtt"],
    "数据": ["json"],
    "白板": ["superboard"],
    "压缩包": ["zip", "rar", "7z"],
    "视频": ["m3u8", "mp4", "mov", "avi", "webm"],
    "音频": ["mp3", "wav", "m4a", "aac", "flac", "ogg"],
}
DETAIL_TYPE_RULES = [
    ("视频", ["video", "视频"]),
    ("音频", ["audio", "音频"]),
    ("图片", ["image"]),
    ("习题", ["习题", "作业"]),
    ("试卷", ["试卷", "考试"]),
]
PROBE_OK = ["ok_with_file_items", "ok_no_file_items"]

# ---------------------------------------------------------------- fixed values: requests
AGE_PATTERNS = [r"(\d+)\s*岁", r"(\d+)\s*周岁", r"年级?为\s*(\d+)"]
GRADE_NAMES = [
    ("一年级", 1), ("二年级", 2), ("三年级", 3), ("四年级", 4), ("五年级", 5), ("六年级", 6), ("七年级", 7),
    ("八年级", 8), ("九年级", 9), ("初一", 7), ("初二", 8), ("初三", 9),
]
AGE_STAGES = [(3, 5, "学前"), (6, 9, "小学低年级"), (10, 11, "小学中年级"), (12, 12, "小学高年级")]
STAGE_RULES = [
    ("学前", ["学前", "幼儿园"]),
    ("小学", ["小学"]),
    ("小学低年级", ["小学低年级", "一二年级"]),
    ("小学中年级", ["小学中年级", "三四年级"]),
    ("小学高年级", ["小学高年级", "五六年级"]),
]
BRIDGE_PROFILE = "幼小衔接"
PRESCHOOL = "学前"
PROFILE_RULES = [
    ("零基础", ["零基础", "入门"]),
    ("基础薄弱", ["基础薄弱", "基础差"]),
    ("进阶", ["进阶", "提高"]),
    ("兴趣启蒙", ["兴趣", "启蒙"]),
    ("备考", ["备考", "考试"]),
    ("幼小衔接", ["幼小衔接", "上一年级"]),
    ("亲子共读", ["亲子", "共读", "一起读"]),
]
DOMAIN_RULES = [
    ("音乐", ["儿歌", "童谣"]),
    ("百科", ["恐龙", "宇宙", "太空", "人体", "动物", "植物"]),
    ("数学", ["数学", "算术", "计算", "四则", "加减乘除", "几何", "代数"]),
    ("语文", ["语文", "拼音", "汉字", "识字", "阅读", "写作", "作文"]),
    ("英语", ["英语", "英文", "abc", "phonics", "自然拼读"]),
    ("科学", ["科学", "物理", "化学", "生物", "实验"]),
    ("百科", ["百科", "知识"]),
    ("文学", ["文学", "唐诗", "宋词", "古诗", "诗歌", "成语", "故事"]),
    ("音乐", ["音乐", "歌曲", "旋律"]),
    ("艺术", ["美术", "画画", "绘画", "手工", "折纸", "剪纸"]),
    ("体育", ["体育", "运动", "游戏", "跳绳", "跑步"]),
]
SUBJECTS = ["数学", "语文", "英语", "科学"]
TOPIC_RULES = [
    ("四则整数运算", ["四则", "加减乘除", "整数运算"]),
    ("四则混合运算", ["混合运算", "四则混合运算"]),
    ("拼音识字", ["拼音", "识字", "汉字"]),
    ("唐诗宋词启蒙", ["唐诗", "宋词", "古诗", "诗词"]),
    ("唐诗宋词", ["唐诗", "宋词", "古诗", "诗词"]),
    ("儿童百科", ["儿童百科", "百科"]),
    ("恐龙百科", ["恐龙", "恐龙百科"]),
    ("儿歌", ["儿歌", "童谣"]),
    ("英文儿歌", ["英文儿歌", "英语儿歌"]),
    ("绘本", ["绘本", "图画书"]),
    ("英语启蒙", ["英语启蒙", "英文启蒙"]),
]
# (domain, [(topic, terms)], topic when none of the terms occurs)
DOMAIN_TOPICS = [
    ("数学", [("计算练习", ["计算", "运算"])], "数学学习"),
    ("语文", [("拼音学习", ["拼音"]), ("识字学习", ["识字"])], "语文学习"),
    (
        "百科",
        [(f"{t}百科", [t]) for t in ["恐龙", "宇宙", "太空", "地球", "人体", "动物", "植物"]],
        "儿童百科",
    ),
]
SUBTOPIC_RULES = [
    (["恐龙"], ["恐龙", "百科"]),
    (["加法", "减法", "乘法", "除法"], ["加减乘除"]),
]
EARLY_TYPE_RULES = [(["音频", "视频", "歌词"], ["儿歌", "童谣"]), (["百科文章", "图片"], ["图文"])]
REQUEST_TYPE_RULES = [
    ("教材", ["教材", "课本", "教科书", "电子教材"]),
    ("课件", ["课件", "ppt", "演示文稿", "教案"]),
    ("习题", ["习题", "练习", "练一练", "题", "作业", "巩固"]),
    ("试卷", ["试卷", "测试", "考试"]),
    ("视频", ["视频", "网课", "讲解", "课程"]),
    ("音频", ["音频", "录音", "听", "mp3"]),
    ("图片", ["图片", "图像", "插图"]),
    ("绘本", ["绘本", "图画书"]),
    ("游戏", ["游戏", "互动"]),
    ("百科文章", ["百科", "图文", "文章"]),
]
LATE_TYPE_RULES = [(["音频"], ["听"]), (["视频", "百科文章"], ["看", "读"]), (["习题"], ["练", "题"])]
GOAL_BY_TYPE = [("听赏", ["音频"]), ("练习", ["习题", "试卷"]), ("学习", ["视频"])]
GOAL_RULES = [
    ("启蒙", ["启蒙", "入门", "基础", "零基础"]),
    ("预习", ["预习", "提前学"]),
    ("复习", ["复习", "巩固"]),
    ("练习", ["练习", "习题", "做题"]),
    ("拓展", ["拓展", "延伸", "扩展"]),
    ("阅读", ["阅读", "看书", "读书"]),
    ("听赏", ["听", "听赏", "聆听"]),
    ("备课", ["备课", "老师用", "上课用", "课堂教学"]),
    ("查阅", ["查阅", "参考", "资料"]),
]
NO_GOAL = "未指定"
DIFFICULTY_RULES = [
    ("启蒙", ["启蒙", "入门", "简单"]),
    ("基础", ["基础", "初级"]),
    ("同步", ["同步", "教材同步"]),
    ("提高", ["提高", "进阶"]),
    ("竞赛", ["竞赛", "奥数"]),
]
YOUNG_DIFFICULTY = "启蒙"
REQUEST_FORMAT_RULES = [
    ("PDF", ["pdf", "可打印", "打印"]),
    ("DOC", ["doc", "word", "文档", "可打印", "打印"]),
    ("PPT", ["ppt", "演示文稿"]),
    ("视频", ["视频"]),
    ("音频", ["音频", "mp3"]),
]
SOURCE_RULES = [
    ("本地资料库", ["本地", "本地资料库", "已有"]),
    ("官方", ["官方", "国家平台", "智慧教育"]),
    ("出版社", ["出版社"]),
]
VERSIONS = ["人教版", "统编版", "北师大版", "苏教版", "外研版", "部编版"]
VOLUMES = ["上册", "下册", "全一册", "必修", "选修"]
CONSTRAINT_RULES = [("适合打印", ["可打印", "打印"]), ("免费", ["免费"]), ("中文", ["中文"]), ("英文", ["英文"])]
FULL_SCOPE_TERMS = ["全部", "全套", "整套", "所有", "都要", "都下载", "完整", "合集"]
COVERAGE_RULES = [
    ("resource_set", ["资料", "资源", "材料"]),
    ("video", ["视频", "课程", "网课"]),
    ("courseware", ["课件", "ppt", "演示文稿"]),
    ("practice", ["习题", "练习", "作业", "试卷"]),
    ("audio", ["音频", "儿歌", "听"]),
    ("image_or_article", ["图片", "图文", "绘本"]),
]
LOCAL_TERMS = ["本地", "已有"]
LOCAL_TASK_TERMS = ["本地"]
NAMED_RESOURCE_TERMS = ["这份", "这个链接", "这门课", "这个课程", "资源名", "标题为"]
BROAD_TERMS = ["看看", "了解", "推荐"]
TEXTBOOK_TYPE = "教材"
WIDE_TOPICS = ["数学学习", "语文学习", "英语学习", "儿童百科"]
VAGUE_TOPICS = ["儿童百科", "数学学习", "语文学习"]
NARROWING_TERMS = ["四则", "拼音", "识字", "恐龙", "宇宙", "人体", "动物"]
DOWNLOAD_TERMS = ["下载"]
PRINT_TERMS = ["打印"]
QUESTIONS = {
    "age": "孩子大概几岁或几年级？",
    "topic": "想围绕哪个学习主题？比如数学、语文、英语、百科等。",
    "narrow": "想学哪个具体的主题？",
    "type": "需要文档、图片、音频还是视频？",
    "vague_topic": "想围绕哪个主题？比如识字、数学启蒙、英语、百科或儿歌。",
}
PRIMARY_GOALS = {"练习": "练习题", "听赏": "可听赏", "阅读": "可阅读", "备课": "备课资料", "启蒙": "启蒙材料"}
DEFAULT_PRIMARY_GOAL = "主题匹配"
AVOID = ["来源不明", "强制下载器", "成人化内容"]
PROFILE_WEIGHTS = {
    "relevance": 0.30, "age_fit": 0.20, "authority": 0.15, "accessibility": 0.10, "format": 0.10, "safety": 0.15,
}
GOAL_WEIGHTS = {"练习": {"relevance": 0.35, "format": 0.15}, "听赏": {"format": 0.20, "relevance": 0.25}}
TEXTBOOK_WORDS = ["教材", "课本", "教科书", "电子教材"]
