"""Rows of the grammar on lines as pages have them."""

from pyspark.sql import functions as F

from strataloom.operators import extraction

ROWS = {
    "001期：☆绝杀二肖☆((牛马))开:鼠01准": [(1, "牛马", "鼠01")], "002期:将杀两肖 开:龙12准【羊 鸡】": [(2, "羊鸡", "龙12")], "003期 ★【绝 杀 ② 肖】★ 【狗、猪】 开：？？": [(3, "狗猪", "？？")],
    "004期:必杀(2)肖◢鼠虎◣ － (开:01对)": [(4, "鼠虎", "01")], "005期:【禁杀2肖→兔龙】开:02": [(5, "兔龙", "02")], "006期【不要二肖码】〈蛇猴〉不出 这两只 开03": [(6, "蛇猴", "03")],
    "007期:★绝杀★【牛羊】开:04准": [(7, "牛羊", "04")], "008期➹砍杀两肖➹『马.鸡』←開:05赢": [(8, "马鸡", "05")], "009期:杀【牛狗】肖不出啦开:06": [(9, "牛狗", "06")],
    "010期:(稳杀二肖)✺猪鼠✺开:07": [(10, "猪鼠", "07")], "011期:高手今日推荐绝杀精选的二肖给大家【虎兔】开:08准": [(11, "虎兔", "08")], "012期:某某温杀【龙蛇】肖开:09": [(12, "龙蛇", "09")],
    "013期:死杀二肖-(猴牛)-開:10": [(13, "猴牛", "10")], "014期:绝杀二肖【牛牛】开:11": [], "015期:绝杀二肖 牛马 开:12": [], "400期:绝杀二肖【牛马】开:13": [], "016期:推荐【牛马】开:14": [], "017期:作者绝杀二肖【牛马】开:15": [],
    "018期 绝杀二肖【牛马】 019期:绝杀二肖【羊鸡】开:16": [(19, "羊鸡", "16")], "020期:绝杀三肖【牛马】开:17": [], "021期 喜欢二肖【牛马】 开:18": []}


def test_rows_of_the_grammar(spark):
    df = spark.createDataFrame([(t,) for t in ROWS], "t string").repartition(2)
    rows = df.select("t", extraction.bank_rows(F.col("t"), F.lit(0)).alias("r")).collect()
    assert {x.t: [(r.period, r.value, r.open_result) for r in x.r] for x in rows} == ROWS
    # without a word of the meaning only where it is not asked for
    bare = spark.createDataFrame([("022期【牛马】开:19",)], "t string")
    assert [len(bare.select(extraction.bank_rows(F.col("t"), F.lit(5), semantic=s).alias("r")).first().r) for s in (True, False)] == [0, 1]
