"""Vocabularies of the legal domain. All tables here are fixed values: labels, words and patterns that results depend on."""

from __future__ import annotations

#: Domain of a text by keyword votes; the earlier domain wins a tie.
DOMAINS = {
    "lao_dong": ["lao động", "hợp đồng lao động", "tiền lương", "bảo hiểm xã hội", "sa thải", "thôi việc", "người lao động"],
    "dan_su": ["dân sự", "hợp đồng", "tài sản", "thừa kế", "ly hôn", "hôn nhân gia đình", "bồi thường"],
    "hinh_su": ["hình sự", "tội phạm", "xử phạt", "phạt tù", "tội", "vi phạm hình sự", "truy tố"],
    "hanh_chinh": ["hành chính", "xử phạt hành chính", "giấy phép", "thủ tục hành chính", "cơ quan nhà nước"],
    "thuong_mai": ["thương mại", "doanh nghiệp", "kinh doanh", "thuế", "xuất nhập khẩu", "hải quan"],
    "dat_dai": ["đất đai", "bất động sản", "quyền sử dụng đất", "nhà ở", "xây dựng"],
    "ke_toan": ["kế toán", "tài chính", "báo cáo tài chính", "kiểm toán", "ngân sách"],
}

#: Words that are no keywords of a chunk.
KEYWORD_STOP_WORDS = [
    "và", "của", "trong", "là", "có", "các", "được", "theo", "cho", "với",
    "về", "đến", "từ", "tại", "hoặc", "nhưng", "nếu", "khi", "này", "đó",
    "để", "không", "thì", "mà", "như", "phải", "sẽ", "đã", "vì", "bởi",
]

#: Words that are no part of a keyphrase.
KEYPHRASE_STOP_WORDS = [
    "và", "của", "các", "có", "là", "được", "trong", "cho", "về",
    "theo", "tại", "đến", "từ", "với", "hoặc", "không", "này",
    "những", "đã", "sẽ", "để", "thì", "do", "khi", "trên", "dưới",
    "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín", "mười",
    "thứ", "đó", "như", "nếu", "mà", "vào", "ra", "lên", "xuống",
    "bởi", "vì", "nên", "nhưng", "còn", "sau", "trước", "ngoài",
    "qua", "khác", "cũng", "chỉ", "đây", "kể", "hơn", "ít", "nhiều",
    "phải", "cần", "mọi", "tất", "cả", "một số", "quy định",
    "điều", "khoản", "điểm", "luật", "nghị", "định", "thông", "tư",
    "văn", "bản", "pháp", "số", "ngày", "tháng",
]

#: What a question's words are also said as.
SYNONYMS = {
    "sa thải": ["chấm dứt hợp đồng lao động", "đuổi việc"],
    "phạt": ["xử phạt", "chế tài", "hình phạt"],
    "hợp đồng": ["thỏa thuận", "giao kết"],
    "hiệu lực": ["còn hiệu lực", "có giá trị pháp lý"],
    "điều khoản": ["quy định", "nội dung"],
}

#: Patterns of each concept; a text without any is OTHER_CONCEPT.
CONCEPTS = {
    "dinh_nghia": [r"giải thích từ ngữ", r"\blà\s+\w.{5,}", r"được hiểu là", r"có nghĩa là", r"theo (luật|quy định) này.{0,20}(là|gồm)"],
    "pham_vi": [r"phạm vi (điều chỉnh|áp dụng)", r"đối tượng áp dụng", r"luật này (quy định|điều chỉnh|áp dụng)", r"(không )?áp dụng (đối với|cho)"],
    "nguyen_tac": [
        r"nguyên tắc (kế toán|lập|trình bày|ghi nhận)", r"chuẩn mực (kế toán|đạo đức)", r"yêu cầu kế toán", r"phải (phản ánh|ghi nhận|trình bày).{0,40}trung thực", r"nhất quán",
    ],
    "nghia_vu": [r"\bphải\b", r"\bcó trách nhiệm\b", r"\bchịu trách nhiệm\b", r"\bcó nghĩa vụ\b", r"bắt buộc", r"phải (lập|nộp|lưu|báo cáo|kiểm tra|thực hiện|tuân thủ)"],
    "quyen_loi": [r"\bđược\b.{0,30}(quyền|hưởng|phép)", r"\bcó quyền\b", r"được (lựa chọn|sử dụng|yêu cầu|đề nghị|từ chối)", r"quyền (của|hành nghề|hành|kiểm tra)"],
    "cam_ket": [r"\bkhông được\b", r"\bcấm\b", r"\bnghiêm cấm\b", r"không (được phép|có quyền)", r"cấm (làm|thực hiện|sử dụng|cung cấp)"],
    "che_tai": [
        r"xử (lý|phạt|phạt vi phạm)", r"hình thức xử", r"vi phạm.{0,20}(bị|sẽ bị|phạt|xử lý)", r"bồi thường", r"thu hồi (giấy phép|chứng chỉ|quyết định)", r"đình chỉ", r"tước (quyền|chứng chỉ)",
    ],
    "thu_tuc": [r"hồ sơ", r"trình tự", r"thủ tục", r"(nộp|gửi|đăng ký|đăng nộp).{0,30}(cơ quan|bộ|sở)", r"thời hạn.{0,20}(ngày|tháng|năm)", r"cấp (giấy|chứng nhận|chứng chỉ)"],
    "to_chuc": [
        r"bộ máy kế toán", r"kế toán trưởng", r"người làm kế toán", r"tổ chức (bộ máy|kế toán|kiểm tra|nghề nghiệp)", r"(bộ tài chính|cơ quan quản lý nhà nước).{0,30}(quy định|ban hành|hướng dẫn)",
        r"hội (kế toán|kiểm toán)",
    ],
    "bao_cao": [r"báo cáo tài chính", r"báo cáo kế toán", r"công khai", r"công bố", r"kiểm toán", r"kiểm tra kế toán", r"lập (và gửi|và nộp|báo cáo)"],
}
OTHER_CONCEPT = "khac"

#: References to legal texts by type; the first group is the reference's value.
REFERENCES = {
    "THONG_TU": r"(?iu)Thông\s+tư\s+(?:số\s+)?([\d/]+(?:/TT-(?U:\w)+)?)",
    "NGHI_DINH": r"(?iu)Nghị\s+định\s+(?:số\s+)?([\d/]+(?:/NĐ-CP)?)",
    "LUAT": r"(?iuU)Luật\s+([\w\s]+?)(?:\s+số\s+|năm|\d{4}|$)",
    "DIEU": r"(?iu)Điều\s+(\d+)",
    "KHOAN": r"(?iu)Khoản\s+(\d+)",
    "DIEM": r"(?iu)Điểm\s+([a-zđ]+)",
}

#: Entities of questions by label.
ENTITIES = {
    "LUAT": r"(?iu)Luật\s+[A-ZÀ-Ỹ][a-zà-ỹ\s]+(?:\d{4})?",
    "NGHI_DINH": r"(?iu)Nghị\s+định\s+(?:số\s+)?\d+/\d{4}/NĐ-CP",
    "THONG_TU": r"(?iu)Thông\s+tư\s+(?:số\s+)?\d+/\d{4}/(?:TT-BTC|TT-BLĐTBXH|TT-BTP|TT-BTNMT)",
    "DIEU": r"(?iu)Điều\s+\d+(?:\.\d+)?",
    "KHOAN": r"(?iu)khoản\s+\d+",
    "DIEM": r"(?iu)điểm\s+[a-zđ]",
    "NGAY_THANG": r"\d{1,2}/\d{1,2}/\d{4}",
}

#: What an entity of a question says of the documents that can answer it.
ENTITY_FILTERS = {"LUAT": "luat", "NGHI_DINH": "nghi_dinh", "THONG_TU": "thong_tu"}

#: A document's number, its date of issue, and the date it ceases to be in force.
DOCUMENT_NUMBER = r"(?iu)Số[:\s]+([0-9][^\n]{0,60})"
ISSUE_DATE = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
EXPIRY_DATE = r"(?iu)hết\s+hiệu\s+lực[^.]{0,60}ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"

#: Issuing bodies; the first of these that a head of a document names is taken.
ISSUING_BODIES = [
    "QUỐC HỘI", "ỦY BAN THƯỜNG VỤ QUỐC HỘI", "CHỦ TỊCH NƯỚC",
    "CHÍNH PHỦ", "THỦ TƯỚNG CHÍNH PHỦ", "NGÂN HÀNG NHÀ NƯỚC",
    "BỘ TÀI CHÍNH", "BỘ TƯ PHÁP", "BỘ LAO ĐỘNG", "BỘ CÔNG THƯƠNG",
    "BỘ Y TẾ", "BỘ GIÁO DỤC", "BỘ CÔNG AN", "BỘ QUỐC PHÒNG",
    "BỘ KẾ HOẠCH VÀ ĐẦU TƯ", "BỘ TÀI NGUYÊN VÀ MÔI TRƯỜNG",
]

#: Lines that are no title.
NO_TITLE = r"(?iu)^(Số|www|http|Copyright|©|\d{1,4}$|Độc\s+lập|Cộng\s+hòa)"

#: Header lines of a law, from the outermost level in: part, chapter, section, article, clause, point.
LAW_LEVELS = [r"(?iu)^\s*phần\s+thứ", r"(?iu)^\s*chương\s+[ivxlc\d]+", r"(?iu)^\s*mục\s+\d+", r"(?iu)^\s*điều\s+\d+", r"^\s*\d+\.\s", r"^\s*[a-zđ]\)\s"]

# Headers of articles, clauses and points, and the names in their keys.
LAW_HEADERS = [r"(?mdiU)^Điều\s+(\d+)[.:]?\s*(.*)", r"(?mdU)^\s*(\d+)\.\s+(.*)", r"(?mdU)^\s*([a-zđ])\)\s+(.*)"]
LAW_KEYS = ["dieu", "khoan", "diem"]
LAW_UNTITLED = "Nội dung"
