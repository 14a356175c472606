"""File category of an extension."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category -> extensions.
CATEGORY_EXTENSIONS = {
    "pdf": ["pdf"],
    "text": ["txt", "mht", "url", "vcf", "hhc"],
    "book": ["epub", "mobi", "azw3", "fb2", "djvu", "chm", "caj"],
    "doc": ["doc", "docx", "odt", "rtf"],
    "ppt": ["ppt", "pptx", "pps"],
    "xls": ["xls", "xlsx"],
    "csv": ["csv"],
    "image": ["jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp", "webp", "svg"],
    "code": ["html", "htm", "aspx", "css", "js", "xml", "json", "ini", "bat"],
    "video": ["mp4", "flv", "swf", "rm", "rmvb", "wmv", "mpg", "mts", "f4v", "asx"],
    "audio": ["mp3", "wav", "wma", "ape", "m4a", "mpga"],
    "archive": ["iso", "msi", "dat"],
    "database": ["db", "itf"],
    "markdown": ["md", "markdown"],
}
DEFAULT_CATEGORY = "file"


def file_category(ext: Column) -> Column:
    lowered = F.lower(ext)
    chain = F
    for category, extensions in CATEGORY_EXTENSIONS.items():
        chain = chain.when(lowered.isin(extensions), category)
    return chain.otherwise(DEFAULT_CATEGORY)
