"""Character-level folding of Chinese text: width, case and traditional forms."""

from __future__ import annotations

import unicodedata

# Traditional characters and, at the same place, their simplified forms.
TRADITIONAL = (
    "寧廣蘇數維圖瀋門連東長鄭慶濟無漢貴學碩專歷織識譜習機覺業視處語壓開發運務時間續驗證訓練經產據庫實術測試評設計師級"
    "萬員體統網絡電動團軟優顧問導構與為這個來們對說請點義標準類結論認見觀記調變轉輸進遠邊過還達選適區華單雙變劃書畫當會"
    "傳嵌測滲話應廈後鑒關錫陽樂龍飛銳諾啟聯邁聖創達靈雲億豐閩軍貿順齊嶺島濱滬藝馬魚鳥車軸輕載輪錄針鋼銀鏈鑽頭題顏風養館饋"
)
SIMPLIFIED = (
    "宁广苏数维图沈门连东长郑庆济无汉贵学硕专历织识谱习机觉业视处语压开发运务时间续验证训练经产据库实术测试评设计师级"
    "万员体统网络电动团软优顾问导构与为这个来们对说请点义标准类结论认见观记调变转输进远边过还达选适区华单双变划书画当会"
    "传嵌测渗话应厦后鉴关锡阳乐龙飞锐诺启联迈圣创达灵云亿丰闽军贸顺齐岭岛滨沪艺马鱼鸟车轴轻载轮录针钢银链钻头题颜风养馆馈"
)
FOLD = {ord(a): b for a, b in zip(TRADITIONAL, SIMPLIFIED, strict=True)}


def simplify(text: str) -> str:
    """Traditional characters of the table replaced; all others kept."""
    return text.translate(FOLD)


def fold(text: str) -> str:
    """NFKC, lower case, simplified characters. The empty text stays empty."""
    return unicodedata.normalize("NFKC", text).lower().translate(FOLD)


def is_hanzi(char: str) -> bool:
    return "一" <= char <= "鿿" or "㐀" <= char <= "䶿"
