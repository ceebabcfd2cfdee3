"""A small deterministic corpus of source files, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.files import from_table

FILES: dict[str, str] = {
    "src/main/java/shop/OrderController.java": """package shop;
import org.springframework.web.bind.annotation.*;

@RestController
@RequestMapping("/orders")
public class OrderController {
    @GetMapping("/{id}")
    public Order one(@PathVariable Long id) { return service.find(id); }

    @PostMapping
    public Order add(@RequestBody OrderForm form) {
        String sql = "insert into orders values ('" + form.name + "')";
        jdbc.execute(sql);
        return null;
    }

    @PreAuthorize("hasRole('ADMIN')")
    @DeleteMapping("/{id}")
    public void drop(@PathVariable Long id) { service.drop(id); }
}
""",
    "src/main/java/shop/WebSecurity.java": """package shop;
public class WebSecurity {
    SecurityFilterChain chain(HttpSecurity http) throws Exception {
        http.csrf().disable();
        http.cors(c -> c.allowedOrigins("*"));
        http.authorizeHttpRequests().anyRequest().permitAll();
        http.sessionManagement().sessionFixation().none();
        return http.build();
    }
}
""",
    "src/main/java/shop/OrderRepository.java": """package shop;
@Repository
public interface OrderRepository extends JpaRepository<Order, Long> {
    @Query("select o from Order o where o.name = '" + NAME + "'")
    List<Order> named();

    @Query(value = "select * from orders order by ${column}", nativeQuery = true)
    List<Order> sorted();

    @Query("select o from Order o where o.id = :id")
    Order byId(Long id);
}
""",
    "src/main/java/shop/Files.java": """package shop;
public class Files {
    String apiKey = "q8Zr2LmX0vTn7KsB4yHdW1cP";
    public void open(HttpServletRequest request) {
        String name = request.getParameter("name");
        helper.run(name);
        Runtime.getRuntime().exec("ls " + name);  // nosec CMD-100
        new FileInputStream(name);
    }
}
class helper {
    public void run(String command) {
        String full = command + " --all";
        Runtime.getRuntime().exec(full);
    }
    public void safe(String id) {
        PreparedStatement s = c.prepareStatement("select 1 where a = ?");
        s.setString(1, id);
    }
}
""",
    "src/main/resources/application.properties": """management.endpoints.web.exposure.include=*
debug=true
server.servlet.session.cookie.http-only=false
""",
    "src/main/resources/mappers/OrderMapper.xml": """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//mybatis.org//DTD Mapper 3.0//EN" "x">
<mapper namespace="shop.OrderMapper">
  <select id="byId" resultType="Order">
    select * from orders where id = #{id}
  </select>
  <select id="sorted" resultType="Order">
    select * from orders
    order by ${orderBy}
  </select>
  <select id="like" resultType="Order">
    select * from orders where name like '%${name}%'
  </select>
  <delete id="many">
    delete from orders where id in
    <foreach collection="list" item="x">${code}</foreach>
    <if test="y != null"> and y = ${y}</if>
  </delete>
  <update id="open">
    update orders set total = ${total}
</mapper>
""",
    "web/app/settings.py": """DEBUG = True
SECRET_KEY = "p4-9dk2lq8x7zt6m1w0v5b3n"
from django.conf import urls
""",
    "web/app/views.py": """from django.http import HttpResponse
@csrf_exempt
def show(request):
    \"\"\"
    cursor.execute("select %s" % name)
    \"\"\"
    cursor.execute("select * from t where a = %s" % request.GET["a"])
    return mark_safe(body)
""",
    "web/app/page.html": """<p>{{ body | safe }}</p>
{% autoescape off %}
""",
    "web/flask/main.py": """from flask import Flask
app = Flask(__name__)
app.secret_key = "dev"
def go():
    db.execute(f"select {x}")
    return redirect(request.args["u"])
app.run(debug=True)
""",
    "front/package.json": '{"dependencies": {"react": "18", "express": "4"}}\n',
    "front/Page.jsx": """import React from 'react';
export const Page = (props) => <div dangerouslySetInnerHTML={{__html: props.html}} />;
const a = <a target="_blank" href={base + path}>x</a>;
localStorage.setItem("token", t);
eval(code);
""",
    "front/View.vue": "<template><p v-html=\"x\"></p></template>\n",
    "front/angular.ts": "import '@angular/core';\nthis.s.bypassSecurityTrustHtml(x);\n",
    "front/angular.json": "{}\n",
    "svc/main.go": """package main
import "crypto/md5"
func h(r *http.Request) {
    db.Query("select * from t where a = '" + r.FormValue("a") + "'")
    exec.Command("sh", "-c", cmd).Run()
    http.Get(url)
    password := "longenough1"
}
""",
    "svc/Data.cs": """var c = new SqlCommand("select " + x);
var f = new BinaryFormatter();
var m = MD5.Create();
var d = new XmlDocument();
""",
    "svc/App.kt": """db.rawQuery("select $x", null)
web.settings.javaScriptEnabled = true
val token = "abcdefgh1"
""",
    "svc/index.php": """<?php
$q = $_GET['q'];
exec($q);
mysql_query("select " . $_POST['a']);
echo $_GET['x'];
unserialize($data);
""",
    "svc/app.rb": """User.where("name = '#{params[:n]}'")
system("ls #{dir}")
YAML.load(body)
redirect_to params[:u]
""",
    "svc/lib.rs": """unsafe { std::mem::transmute(x) }
a.unwrap(); b.unwrap(); c.unwrap();
d.unwrap(); e.unwrap(); f.unwrap();
conn.query(&format!("select {}", x));
println!(&buf);
""",
    "svc/View.swift": """let token = "abcdefgh12"
let u = URL(string: address)
CC_MD5(data, len, &digest)
let r = arc4random()
""",
    "ops/main.tf": """resource "aws_s3_bucket" "logs" {
  acl = "public-read"
}
resource "aws_db_instance" "db" {
  publicly_accessible = true
  storage_encrypted = false
  password = "hunter2hunter2"
}
""",
    "ops/pod.yaml": """apiVersion: v1
kind: Pod
metadata:
  name: web
  namespace: default
spec:
  hostNetwork: true
  containers:
  - image: shop/web:latest
    securityContext:
      privileged: true
""",
    "ops/stack.yaml": """AWSTemplateFormatVersion: 2010-09-09
Resources:
  Bucket:
    Type: AWS::S3::Bucket
    Properties:
      AccessControl: PublicRead
""",
    "ops/Dockerfile": """FROM base:latest
ENV API_KEY=abcdef123456
RUN apt-get install -y curl
RUN curl http://x | sh
EXPOSE 22
""",
    "src/test/java/shop/FilesTest.java": 'class FilesTest { String password = "test-value-123"; }\n',
    "vendor/lib/old.java": 'class Old { String password = "zq81xk27vm93"; }\n',
    "docs/readme.txt": "nothing to see\n",
    "empty.py": "",
}

#: Files for the analyses that read the structure of code.
CODE: dict[str, str] = {
    "app/web/ReportController.java": """package app.web;

@RestController
public class ReportController extends BaseController implements Reports, Audited {
    private final JdbcTemplate jdbc;

    @GetMapping("/report")
    public String report(@RequestParam("id") String id, @RequestHeader String agent) {
        String sql = "SELECT * FROM r WHERE id = " + id;
        statement.executeQuery(sql);
        String safe = escapeHtml(id);
        out.println(safe);
        logger.info(agent.trim());
        return sql;
    }

    @PostMapping("/run")
    public void run(@RequestBody String body, int times) {
        body = body + times;
        runtime.exec(body);
        String other = body;
        runtime.exec(other);
        List<String> all = new ArrayList<>(body);
        files.delete(all);
    }

    public void plain(HttpServletRequest request) {
        String name = request.getParameter("name");
        statement.executeQuery("select " + name);
        response.sendRedirect(name);
        new Loader().openConnection(name);
    }
}
""",
    "app/web/BaseController.java": """package app.web;
abstract class BaseController extends Root implements Closeable {
    protected abstract void close(int how);
    void run(String what) { close(1); }
    static class Inner { String go(List<String> names, Map<String, Integer> counts) { return names.get(0); } }
}
class Root { void plain() { helper(); } }
""",
    "svc/handler.go": """package svc

type Server struct {
	db *sql.DB
}

func (s *Server) find(w http.ResponseWriter, r *http.Request) {
	rows, _ := s.db.Query("select * from t where id = " + r.FormValue("id"))
	out, _ := exec.Command("ls", r.URL.Query().Get("dir")).Output()
	f, _ := os.Open(filepath.Clean(name))
	resp, _ := http.Get(fmt.Sprintf("http://%s/", host))
}
""",
    "svc/Repo.cs": """public class Repo {
    public async Task<int> Count(string name) { return db.Users.Where(name).Count(); }
    private string label = @"a path";
}
""",
    "svc/Main.kt": """class Main {
    fun start(port: Int) { server.listen(port, "127.0.0.1") }
}
object Single
""",
    "svc/cart.php": """<?php
class Cart {
    function add($item) { $this->store($item); Log::info("added $item"); }
}
""",
    "svc/order.rb": """class Order
  def total(items)
    items.sum(:price)
    puts 'done'
  end
end
""",
    "svc/store.rs": """pub struct Store { name: String }
impl Store {
    pub async fn open(path: &str) { std::fs::read(path); println("opened"); }
}
""",
    "svc/Item.swift": """struct Item { let id: Int }
class Basket { func add(item: Item) { items.append(item) } }
let label = "basket"
""",
    "web/urls.py": """from django.urls import path
urlpatterns = [
    path('orders/', views.orders),
    path("orders/<int:pk>/", views.order),
]
""",
    "web/settings.py": "SECRET = 1\nDEBUG = True\n",
    "web/flaskapp.py": """from flask import Flask
app = Flask(__name__)
@app.route('/login')
def login(): pass
@app.route("/items/<id>")
def item(id): pass
""",
    "site/pages/api/users.js": "export default (req, res) => { if (req.method === 'POST') { res.end() } }\n",
    "site/app/api/health.ts": "export const x = 1\n",
    "site/next.config.js": "module.exports = { reactStrictMode: true }\n",
    "site/package.json": '{"dependencies": {"next": "1"}}\n',
}

RULES: list[dict] = [
    {"id": "SQLI-100", "name": "Concatenated statement", "severity": "critical", "confidence": "high", "cwe": "CWE-89", "owasp": "A03", "tags": ["sql-injection"], "languages": ["java", "python"],
     "detection": {"patterns": [{"pattern": r"(?:insert|select)[^\n]*\"\s*\+"}, {"pattern": r"execute\([^)]*%", "language": "python"}]}},
    {"id": "CMD-100", "name": "Command run", "severity": "high", "confidence": "high", "cwe": "CWE-78", "owasp": "A03", "tags": ["command-injection"], "languages": ["java"], "detection": {"patterns": [r"\.exec\("]}},
    {"id": "SECRET-100", "name": "Secret in source", "severity": "high", "confidence": "medium", "cwe": "CWE-798", "owasp": "A07", "tags": ["secret", "credentials"], "file_patterns": ["*.java", "*.py"],
     "detection": {"patterns": [{"pattern": r"(?:password|apikey|secret_key)\s*=\s*\"[^\"]{8,}\"", "case_insensitive": True}]}},
    {"id": "CFG-100", "name": "Debug without a profile", "severity": "low", "languages": ["properties"], "tags": ["config"], "detection": {"patterns": [{"pattern": r"^debug=true", "missing": "profile|env"}]}},
    {"id": "CFG-101", "name": "Debug with a cookie", "severity": "info", "languages": ["properties"], "detection": {"patterns": [{"pattern": r"^debug=true", "missing": "cookie"}]}},
    {"id": "OFF-100", "name": "Switched off", "severity": "low", "enabled": False, "detection": {"patterns": ["x"]}},
    {"id": "DEAD-100", "name": "Without a pattern", "patterns": ["x"]},
]


def files(spark: SparkSession, source: dict[str, str] = FILES) -> DataFrame:
    """The corpus as a files table."""
    return from_table(spark.createDataFrame(list(source.items()), "path string, content string"))


def quoted(text: str | None) -> str:
    """A text as an SQL literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql(source: dict[str, str] = FILES) -> str:
    """The corpus as an SQL query of (path, content, name, ext)."""
    rows = ",\n".join(f"({quoted(p)}, {quoted(c)})" for p, c in source.items())
    return (
        "SELECT path, content, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext "
        f"FROM (VALUES {rows}) AS f(path, content)"
    )
