"""Rule packs: keyword lists by category. Words, order and repeats are data that results depend on."""

TIER_TECH = [
    "Web3", "ブロックチェーン", "NFT", "DAO", "メタバース", "生成AI", "LLM", "ChatGPT", "AI", "人工知能", "IoT", "ドローン", "DX",
    "デジタル", "ロボット", "自動化", "衛星", "ソリューション", "プラットフォーム", "システム",
]
TIER_PRIMARY = [
    "農業", "農家", "農産物", "畜産", "漁業", "林業", "酪農", "栽培", "養殖", "スマート農業", "フードテック", "農林水産", "一次産業", "圃場", "収穫", "品種",
    "JGAP",
]
TIER_USE = [
    "事例", "活用", "導入", "実証実験", "提携", "協業", "開発", "リリース", "発表", "開始", "連携", "提供",
]
GLOBAL_AGRI = [
    "agriculture", "agribusiness", "agronomy", "agrotech", "agtech", "agritech", "farming", "farmer", "farm",
    "livestock", "aquaculture", "aquaponics", "soil", "irrigation", "horticulture", "forestry", "fishery",
    "regenerative ag", "sustainable agriculture", "vertical farming", "food security", "food system",
    "precision agriculture", "smart farming", "digital agriculture", "agritech", "agtech", "vertical farming",
    "sustainable agriculture", "IoT agriculture", "drone farming", "satellite agriculture",
]
GLOBAL_TECH = [
    "blockchain", "artificial intelligence", "machine learning", "IoT", "drone", "satellite", "robotics",
    "automation", "digital twin", "data analytics", "sensor", "computer vision", "climate tech", "biotech",
    "gene editing", "CRISPR", "synthetic biology", "blockchain agriculture", "Web3 farming",
    "metaverse agriculture", "metaverse", "Web3", "Generative AI", "LLM", "ChatGPT", "AI agriculture",
    "machine learning crop", "digital twin farming", "smart contracts agriculture", "NFT agriculture",
    "DeFi agriculture",
]
GLOBAL_RESEARCH = [
    "research", "study", "paper", "journal", "findings", "innovation", "breakthrough", "development", "trial",
    "experiment", "analysis", "report", "publication",
]
CORE_AGRI = [
    "野菜", "農業", "農家", "農産物", "畜産", "漁業", "林業", "酪農", "栽培", "養殖", "収穫", "品種", "圃場", "水産", "乾田直播", "不耕起",
    "リジェネラティブ農業", "環境再生型", "陸上養殖", "植物工場", "バイオ炭", "バイオスティミュラント",
]
TECH_INNOVATION = [
    "AI", "人工知能", "生成AI", "LLM", "エージェント", "Web3", "ブロックチェーン", "NFT", "DAO", "メタバース", "ウォレット", "RWA", "DeFi",
    "スマートコントラクト", "トークンエコノミー", "トークン", "デジタルツイン", "デジタルツイン農業", "ステーブルコイン", "JPYC", "USDC", "USDT", "QR決済",
    "マイナウォレット", "デジタル円", "CBDC", "デジタル通貨", "暗号資産決済", "クリプト決済", "商店街DAO", "地域DAO", "コミュニティDAO", "ガバナンス", "分散型",
    "自律分散", "スマート農業", "IoT", "ドローン", "ロボット", "自動化", "衛星", "DX", "デジタル", "フードテック", "アグリテック", "農業DX", "精密農業",
    "センサー", "コンピュータビジョン", "データ解析", "気象予測", "リモートセンシング", "画像解析", "農業用ドローン", "農業用ロボット", "カーボンクレジット", "ゲノム編集",
    "フードテック", "培養肉", "代替肉", "バイオ炭", "VR", "ソリューション", "プラットフォーム", "システム",
]
CONSUMER_EXPERIENCE = [
    "6次産業化", "直売所", "サブスク", "スタートアップ", "ビジネスコンテスト", "スイーツ", "地ビール", "商品開発", "ブランド", "体験", "ツーリズム", "オーナー制度",
    "レストラン", "マンガ", "昆虫食", "食の安全", "食の安心", "トレーサビリティ", "観光農園", "体験農園", "農泊", "アグリツーリズム", "グリーンツーリズム",
]
SOCIAL_SUSTAINABILITY = [
    "オーガニック", "食料危機", "規格外", "食品ロス", "ゼロ廃棄", "環境再生型", "サステナブル", "熱中症対策", "有機農業", "環境保全", "SDGs", "食料安全保障",
    "食料自給率", "フードロス", "食料廃棄", "鳥獣害", "病害虫", "気候変動", "地方創生", "地域活性化", "地域振興", "中山間地域", "過疎地域", "限界集落", "関係人口",
    "移住促進", "地域課題", "地域DX", "ローカルDX", "補助金", "助成金", "実証実験", "導入事例", "活用事例", "成功事例", "右腕", "サポート", "アシスタント",
    "業務支援", "経営支援", "営農支援", "人手不足", "古米", "耕作放棄地", "高齢化", "後継者不足", "労働力不足", "担い手不足", "農地集約", "農地中間管理機構", "農業従事者",
    "農業労働力", "農業就業人口",
]
HUMAN_STORY = [
    "挑戦", "想い", "高校生", "脱サラ", "奮闘記", "農家グループ", "担い手", "後継者", "就農", "新規就農", "認定農業者", "農業研修", "農業法人", "挑戦", "想い",
    "高校生", "大学生", "脱サラ", "農家グループ", "奮闘記", "地域おこし協力隊", "関係人口", "二地域居住", "移住", "定住",
]
BUSINESS_POLICY = [
    "農業経営", "アグリビジネス", "農業経済", "農業金融", "農業保険", "農業共済", "農業政策", "農業白書", "JAS", "GAP", "HACCP", "有機JAS",
    "GLOBALG.A.P", "地理的表示", "GI", "JA", "農業協同組合", "農業委員会", "ふるさと納税", "農業振興", "基本法", "食料供給",
]
BUZZ = [
    "異業種", "コラボ", "提携", "実証実験", "コンテスト", "MOU", "連携", "ソリューション", "プラットフォーム", "システム", "農機具", "農業機械", "農業資材",
]
#: The publisher's own names, which its feeds are cleaned of as well, are a parameter of the filters.
EXCLUSION = [
    "アグリゲーター", "アグリゲート", "アグリーメント", "aggregator", "aggregate", "agreement",
]
ROBLOX_BUSINESS = [
    "partner", "partnership", "collaboration", "brand", "marketing", "campaign", "retail", "ecommerce",
    "virtual store", "concert", "event", "gucci", "nike", "disney", "experience", "adidas", "lego",
    "warner bros", "unilever", "coca-cola", "mcdonalds", "starbucks", "netflix", "marvel", "dc", "sony",
    "playstation", "xbox",
]
ROBLOX_PLATFORM = [
    "update", "feature", "release", "engine", "studio", "developer", "creator", "economy", "monetization",
    "marketplace", "immesive ads", "UGC",
]
ROBLOX_FINANCE = [
    "earnings", "revenue", "stock", "shares", "investment", "acquisition", "ipo", "financial", "quarterly",
    "growth", "MAU", "DAU",
]
ROBLOX_TECH = [
    "AI", "generative ai", "metaverse", "avatar", "virtual reality", "VR", "AR", "physics", "rendering",
    "phygital", "virtual goods", "digital twin", "shopify", "vr", "virtual reality", "augmented reality", "ar",
]
BOOK_TECH_EXCLUSION = [
    "linux", "リナックス", "windows", "java", "python入門", "ruby", "c++", "c#", "php", "javascript入門", "html", "css",
    "ネットワークエンジニア", "インフラエンジニア", "webエンジニア", "異世界", "ファンタジー", "小説", "漫画", "コミック", "ラノベ", "恋愛", "ホラー", "ミステリー",
    "推理", "レシピ", "料理",
]
EXAM_EXCLUSION = [
    "試験", "模擬試験", "過去問", "問題集", "合格", "資格", "検定", "講習会", "対策テキスト", "予想模試", "受験", "一発合格", "cbt", "テスト対策", "運行管理者",
    "猟銃", "射撃",
]
LIGHT_NOVEL_EXCLUSION = [
    "異世界", "転生", "追放", "無双", "チート", "最強", "俺tueee", "悪役令嬢", "婚約破棄", "聖女", "魔王", "勇者", "冒険者", "ギルド", "スキル", "レベル",
    "ステータス", "召喚", "ダンジョン", "モンスター", "成り上がり", "ハーレム", "奴隷", "従魔", "使い魔", "テイマー", "盗賊", "怪盗", "暗殺者", "アサシン",
    "スローライフ", "一迅社", "一二三書房", "オーバーラップ", "mfブックス", "カドカワbooks", "ファミ通文庫", "電撃文庫", "ga文庫", "mf文庫", "スニーカー文庫",
    "ヒーロー文庫", "hj文庫", "ガガガ文庫", "ダッシュエックス文庫", "アルファポリス", "カクヨム", "なろう系", "web小説", "コミカライズ", "漫画版", "コミック版",
]
REVIEW_HIGH_ENGAGEMENT = [
    "事業承継", "後継者", "経営者", "社長", "つまずく", "失格", "孤独", "依存", "依存症", "ギャンブル", "ドーパミン", "脳", "中毒", "弱さ", "危機", "判断",
    "再起", "再生",
]
REVIEW_PRIORITY_HOOK = [
    "事業承継", "後継者", "社長", "起業", "再起", "生成ai", "chatgpt", "copilot", "農業経営", "地方創生", "食と農", "ステーブルコイン", "dao",
    "トークンエコノミー", "コミュニティマーケティング", "推し経済", "行動経済学", "依存", "ドーパミン", "ギャンブル", "日本経済", "世界経済", "ビジネス小説", "経済小説",
]
REVIEW_TARGET_EXCLUSION = [
    "試験対策", "問題集", "ワークブック", "一問一答", "予想模試", "最短合格", "絶対合格", "要点解説テキスト", "対策標準テキスト", "スマホドリル付き", "初心者講習",
    "無料cbt", "図解入門業界研究", "図解入門よくわかる", "スタートガイド", "養成講座",
]
REVIEW_PRACTICAL_APPLICATION = [
    "実践", "実務", "現場", "導入", "活用", "業務改善", "ケーススタディ", "事例", "ノウハウ", "戦略", "仕組み化", "運営",
]
REVIEW_SERIES_FRIENDLY = [
    "未来", "予測", "2030", "2034", "2027", "世界経済", "大転換", "地政学", "比較", "続編", "続", "大全", "教科書", "戦略",
]
REVIEW_SELF_CONNECTION = [
    "copilot", "chatgpt", "生成ai", "農業ai", "農業", "web3", "nft", "dao", "トークンエコノミー", "コミュニティ", "推し経済",
]
REVIEW_PV = [
    "生成ai", "chatgpt", "copilot", "claude", "gemini", "aiエージェント",
]
REVIEW_STORY_LEARNING = [
    "ビジネス小説", "経済小説", "企業小説", "社会派", "物語",
]
AGRI_STRICT_REQUIRED = [
    "農業", "農家", "農業経営", "農協", "農林水産", "一次産業", "スマート農業", "アグリテック", "agritech", "farmtech", "フードテック", "食と農",
    "地方創生", "地域活性化", "地域dx", "ローカルdx", "web3", "ブロックチェーン", "nft", "dao", "defi", "ステーブルコイン", "トークンエコノミー", "生成ai",
    "chatgpt", "copilot", "claude", "gemini", "llm", "aiエージェント", "ai活用", "ai導入", "ai実務",
]
BOOK_SCORING_NOISE = [
    "ソリューション", "プラットフォーム", "システム", "デジタル", "自動化", "api",
]
POPULAR_REVIEW_SEARCH = [
    "事業承継", "経営", "起業", "生成AI", "AI活用", "AI 業務改善", "農業", "農業経営", "地方創生", "食と農", "Web3", "ステーブルコイン", "DAO",
    "トークンエコノミー", "コミュニティマーケティング", "ブランド戦略", "推し経済", "行動経済学", "依存", "ドーパミン", "投資", "日本経済", "ビジネス小説", "経済小説",
]
#: label, points, keywords
REVIEW_THEMES = [
    ("ビジネス・経営", 12, ["事業承継", "経営", "経営者", "社長", "起業", "起業家", "マネジメント", "組織", "組織運営", "意思決定", "リーダーシップ", "後継者", "再起", "再生", "リブート", "中小企業", "会社経営", "経営学", "チェックリスト"]),
    ("AI時代論・生成AI実践", 10, ["生成ai", "chatgpt", "copilot", "claude", "gemini", "llm", "gpt", "aiエージェント", "人工知能", "ai活用", "ai導入", "業務改善", "自動化", "プロンプト", "ai実務"]),
    ("農業・食・地域", 8, ["農業", "農家", "農業経営", "一次産業", "農協", "食料", "食", "食と農", "フードテック", "地方創生", "地域活性化", "ローカル", "地域", "スマート農業", "農林水産"]),
    ("Web3・トークン経済", 8, ["web3", "ブロックチェーン", "nft", "dao", "defi", "トークン", "トークンエコノミー", "ステーブルコイン", "暗号資産", "仮想通貨", "スマートコントラクト", "cbdc", "rwa", "コミュニティトークン"]),
    ("マーケティング・ブランド", 7, ["マーケティング", "ブランド", "ブランディング", "コミュニティマーケティング", "キャラクターマーケティング", "推し経済", "ファンベース", "コミュニティ", "sns", "広報", "広告", "ポジショニング"]),
    ("心理・依存・行動経済", 7, ["心理", "依存", "依存症", "ドーパミン", "ギャンブル", "行動経済学", "脳", "中毒", "習慣", "バイアス", "セルフコントロール", "欲望", "認知"]),
    ("お金・投資・経済", 6, ["投資", "資産形成", "お金", "金融", "証券", "株式", "経済", "世界経済", "日本経済", "マクロ経済", "インフレ", "金利", "資本主義"]),
    ("小説・物語", 5, ["小説", "物語", "ビジネス小説", "経済小説", "社会派", "長編", "短編", "フィクション", "ミステリ", "サスペンス"]),
]
SEARCH_AXES = [
    ["事業承継", "経営", "起業"],
    ["生成AI", "AI活用", "AI 業務改善"],
    ["農業経営", "地方創生", "食と農"],
    ["ステーブルコイン", "Web3", "DAO"],
    ["コミュニティマーケティング", "ブランド戦略", "推し経済"],
    ["行動経済学", "依存", "ドーパミン"],
    ["日本経済", "投資", "世界経済"],
    ["ビジネス小説", "経済小説", "社会派 小説"],
]

#: Words that occur in the test tables, in the same categories.
FIXTURE = {"core": ["that", "this"], "tech": ["ai", "llm", "iot"], "consumer": ["with"], "social": ["from"], "human": ["and"], "policy": ["gi", "ja"], "buzz": ["release"]}
FIXTURE_EXCLUSION = ["$$$", "%%%"]

#: category, label, points of the news scores (substring match), the first being the gate
NEWS_POINTS = [("core", 3), ("tech", 5), ("consumer", 4), ("social", 4), ("human", 4), ("policy", 3), ("buzz", 2)]
#: the same for books (boundary match)
BOOK_POINTS = [("core", 3), ("tech", 5), ("consumer", 5), ("social", 4), ("human", 4), ("policy", 3), ("buzz", 2)]
DOMESTIC = {"core": CORE_AGRI, "tech": TECH_INNOVATION, "consumer": CONSUMER_EXPERIENCE, "social": SOCIAL_SUSTAINABILITY, "human": HUMAN_STORY, "policy": BUSINESS_POLICY, "buzz": BUZZ}
ROBLOX = [("business", 5, ROBLOX_BUSINESS), ("platform", 5, ROBLOX_PLATFORM), ("finance", 4, ROBLOX_FINANCE), ("tech", 3, ROBLOX_TECH)]

