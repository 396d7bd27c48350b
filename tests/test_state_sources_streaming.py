import json

from pyspark.sql import functions as F

from tests.conftest import rows
from vmlens.operators import state as T
from vmlens.plans import migration as M
from vmlens.sources import binary as B
from vmlens.sources import telemetry as X
from vmlens.streaming import events as E

L = F.lit


def same(got, want):
    if isinstance(got, list) and got and isinstance(got[0], tuple):
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want


def test_t1(make):
    r = make([('k', i, t * 1000000, n) for i, (t, n) in enumerate([(0, 1000), (0, 500), (0, 500), (0, 500), (500, 500), (1500, 2500)])], 'key string,seq long,ts long,tokens long')
    same([(x.outcome, x.ratio) for x in T.token_bucket(r, ['key'], ['seq'], 'ts', 'tokens', 1000, 1100, 1000).orderBy('seq').collect()], [('success', 0.0), ('success', 0.0), ('success', 0.0), ('failure', 0.0), ('success', 0.0), ('over', 1.5)])


def test_t13(make):
    q = make([('a', 1, 'allocate', None, 272, 256), ('a', 2, 'allocate', None, 256, 256), ('a', 3, 'free', 69120, 272, None)], 'k string,o int,op string,at long,length long,align long')
    same([x.address for x in T.allocate_addresses(q, ['k'], ['o'], 4096, 65536).orderBy('o').collect()], [69120, 68864, 69120])


def test_t14(make):
    s = make([('a', 1, 'take', None), ('a', 2, 'take', None), ('a', 3, 'free', 0), ('a', 4, 'take', None), ('a', 5, 'free', 7)], 'k string,o int,op string,slot long')
    same([x.got for x in T.allocate_slots(s, ['k'], ['o'], 'lowest').orderBy('o').collect()], [0, 1, 0, 0, None])


def test_t15(make):
    s = make([('a', 1, 'take', None), ('a', 2, 'take', None), ('a', 3, 'free', 0), ('a', 4, 'take', None), ('a', 5, 'free', 7)], 'k string,o int,op string,slot long')
    same([x.got for x in T.allocate_slots(s, ['k'], ['o'], 'lifo').orderBy('o').collect()][:4], [0, 1, 0, 0])


def test_iperf(value):
    iperf = json.dumps({'end': {'sum_sent': {'bits_per_second': 23957198874.604115}, 'sum': {'packets': 913848, 'lost_packets': 16, 'seconds': 5.000036}}})
    same(value(X.iperf_value(L(iperf))), 23957198874.604115)


def test_pps(value):
    iperf = json.dumps({'end': {'sum_sent': {'bits_per_second': 23957198874.604115}, 'sum': {'packets': 913848, 'lost_packets': 16, 'seconds': 5.000036}}})
    same(value(X.iperf_value(L(iperf), what='pps')), 182765.08409139456)


def test_fio(value):
    fio = json.dumps({'jobs': [{'read': {'io_bytes': 1172783104, 'runtime': 5002}}, {'read': {'io_bytes': 1172234240, 'runtime': 5002}}]})
    same(round(value(X.fio_value(L(fio), 2)), 3), round((1172783104 + 1172234240) / 5.002, 3))


def test_ethr(make):
    same([x.avg_us for x in X.ethr_latencies(make([('{"Avg":"80.712us"}',), ('{"Avg":"1.619ms"}',), ('{"Message":"INFO"}',)], 'value string')).collect()], [80.712, 1619.0])


def test_boot(make):
    same(round(X.boot_seconds(make([('[Debug I/O port: Kernel code 0x40] 0.132 seconds',), ('x',), ('[Debug I/O port: Kernel code 0x41] 0.5845 seconds',)], 'value string')).first()[0], 4), 0.4525)


def test_restore(make):
    ev = X.parse_events(make([('{"timestamp":{"secs":0,"nanos":5505133},"source":"vm","event":"restored","properties":null}',), ('{"bad',), ('',)], 'value string'))
    same(X.restore_ms(ev).first()[0], 5.505133)


def test_balloon(make):
    bb = b''.join((k.to_bytes(2, 'little') + (100 + k).to_bytes(8, 'little') for k in range(16)))
    same(list(B.read_balloon(make([(1, bytearray(bb))], 'k int,content binary'), ['k']).drop('k').first()), list(range(100, 116)))


def test_ranges(make):
    rt = make([(1, 0, 4096, 8192), (1, 1, 2 ** 40, 1)], 'k int,o int,gpa long,length long')
    same([(x.pos, int(x.gpa), int(x.length)) for x in B.read_ranges(B.write_ranges(rt, ['k'], 'o')).orderBy('pos').collect()], [(0, 4096, 8192), (1, 2 ** 40, 1)])


def test_vmdk(value):
    d = '# Disk DescriptorFile\nversion=1\nCID=abc\n\n# Extent description\nRW 2097152 FLAT "disk-flat.vmdk"\nRDONLY 10 FLAT "x y.vmdk" 5\n\n# The Disk Data Base\n#DDB\nddb.x = "1"'
    x = value(B.read_vmdk_descriptor(L(d)))
    same((x.header, [tuple(e) for e in x.extents]), ({'version': '1', 'CID': 'abc'}, [('RW', 2097152, 'FLAT', 'disk-flat.vmdk', 0), ('RDONLY', 10, 'FLAT', 'x y.vmdk', 5)]))


def test_mig(make, value):
    d = '# Disk DescriptorFile\nversion=1\nCID=abc\n\n# Extent description\nRW 2097152 FLAT "disk-flat.vmdk"\nRDONLY 10 FLAT "x y.vmdk" 5\n\n# The Disk Data Base\n#DDB\nddb.x = "1"'
    x = value(B.read_vmdk_descriptor(L(d)))
    m = M.iteration_metrics(make([(1, 0, 1000, 1.0, 1.0), (1, 1, 500, 1.0, 2.0), (1, 2, 100, 1.0, 3.0)], 'm int,i int,b long,t double,e double'), ['m'], 'i', 'b', 't')
    same([(x.i, x.est_downtime_s, x.total_bytes) for x in m.orderBy('i').collect()], [(0, None, 1000), (1, 0.5, 1500), (2, 0.2, 1600)])


def test_conv(make):
    m = M.iteration_metrics(make([(1, 0, 1000, 1.0, 1.0), (1, 1, 500, 1.0, 2.0), (1, 2, 100, 1.0, 3.0)], 'm int,i int,b long,t double,e double'), ['m'], 'i', 'b', 't')
    same(rows(M.convergence(M.decisions(m, 'b', 'e'), ['m'], 'i')), [(1, 2, 'fits')])


def test_trace(make):
    tr = json.dumps({'duration': {'secs': 1, 'nanos': 0}, 'events': {'vmm': [{'timestamp': {'secs': 0, 'nanos': 5}, 'event': 'boot', 'end_timestamp': {'secs': 0, 'nanos': 9}, 'depth': 0}]}})
    same(rows(X.parse_traces(make([(tr,)], 'value string')).select('thread', 'event', 'start_ns', 'end_ns')), [('vmm', 'boot', 5, 9)])


def test_manifest(make):
    same(rows(B.parse_manifest(make([('f', 0, '- name: a'), ('f', 1, "  url: 'http://x'"), ('f', 2, '- name: b')], 'file string,pos int,value string'), ['file']).drop('file')), [(1, {'name': 'a', 'url': 'http://x'}), (2, {'name': 'b'})])


def test_events_are_written_read_as_a_stream_and_fanned_out(spark, make, tmp_path):
    events = X.parse_events(make([('{"timestamp":{"secs":0,"nanos":5505133},"source":"vm","event":"restored","properties":null}',), ('{"bad',), ("",)], "value string"))
    X.write_events(events, f"{tmp_path}/log")
    got = []
    query = E.fan_out(E.read_event_stream(spark, f"{tmp_path}/log"), [lambda batch, n: got.extend(r.event for r in batch.collect())] * 2, f"{tmp_path}/cp")
    query.awaitTermination()
    same(got, ["restored"] * 2)


REQUESTS = [("k", i, t * 1000000, n) for i, (t, n) in enumerate([(0, 1000), (0, 500), (0, 500), (0, 500), (500, 500), (1500, 2500)])]


def test_streaming_limiter_is_the_batch_s(spark, make, tmp_path):
    """Two batches, the limiter's state kept between them; a null key is one of its own."""
    rows = [*REQUESTS, *((None, i + 10, t, n) for _, i, t, n in REQUESTS)]
    requests = make(rows, "key string,seq long,ts long,tokens long").withColumn("kind", L("bytes"))
    buckets = {"bytes": (1000, 1100, 1000)}
    got = {}
    for part in ("seq % 10 < 3", "seq % 10 >= 3"):
        requests.where(part).write.mode("append").parquet(f"{tmp_path}/req")
        limited = E.limited(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/req"), "key", "ts", "kind", "tokens", buckets, "seq")
        query = limited.writeStream.foreachBatch(lambda batch, n: got.update({r.seq: (r.key, r.allowed) for r in batch.collect()})).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
        query.awaitTermination()
    want = T.limit(requests, ["key"], ["seq"], "ts", "kind", "tokens", buckets)
    assert got == {r.seq: (r.key, r.allowed) for r in want.collect()} and len(got) == 12


def test_streaming_windows_and_latest_values(spark, make, tmp_path):
    events = make([("a", 0, 1.0, True), ("a", 30, 5.0, True), ("a", 70, 3.0, True), ("b", 10, 2.0, True), ("b", 20, None, False)], "k string,sec long,v double,ok boolean").withColumn("ts", F.timestamp_seconds("sec"))
    events.write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    out = {}
    for name, df in (("w", E.windowed_counters(stream(), "ts", "10 seconds", "1 minute", ["k"], "v")), ("l", E.latest_values(stream(), ["k"], "sec", ["v"], "ok"))):
        query = df.writeStream.outputMode("update").foreachBatch(lambda batch, n, name=name: out.setdefault(name, []).extend(batch.collect())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination()
    assert {(r.k, r.window.start.minute, r.n, r.total, r.least, r.most) for r in out["w"]} == {("a", 0, 2, 6.0, 1.0, 5.0), ("a", 1, 1, 3.0, 3.0, 3.0), ("b", 0, 2, 2.0, 2.0, 2.0)}
    assert {tuple(r) for r in out["l"]} == {("a", 70, 3.0), ("b", 10, 2.0)}
